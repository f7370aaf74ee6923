"""URL filters by redirect equivalence. DataFrame functions only.

Pages that lead to one another, by a redirect, a canonical link or a mere variant spelling, are
one component. A block on any of them blocks its aliases that no rule judges, unless a rule
allows one of them explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, materialise, table
from .graph import connected_components

#: The rules (verdict, host, path prefix).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

#: Query parameters that say where a visitor came from, not what is shown.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-cased (A-Z) host after the first ``://``; empty for null or without ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical_url(url: Column) -> Column:
    """A spelling that variants of one address share: host (no ``www.``), path without an ending
    slash, and what is left of the query without tracking parameters. Null without a host."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.regexp_replace(F.regexp_replace(query, rf"(^|&)({TRACKING})=[^&]*", ""), "^&", "")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def links_of(html: Column) -> Column:
    """Targets of canonical links and of redirects by ``refresh`` in a page's own markup."""
    link = F.regexp_extract_all(html, F.lit(r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"), 1)
    meta = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh)[^>]*\burl\s*=\s*[\"']?([^\"'\s>;]+)"), 1)
    return F.concat(link, meta)


def absolute(url: Column, target: Column) -> Column:
    """A target seen from its page: as it is, from the page's host, or beside the page."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?://)", 1)
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    return (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(F.regexp_replace(scheme, "//$", ""), target))
        .when(target.startswith("/"), F.concat(scheme, host_of(url), target))
        .otherwise(F.concat(scheme, host_of(url), F.when(folder == "", "/").otherwise(folder), target))
    )


def rule_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def fitting_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, candidates): the rules of each distinct host and the domains above it.

    Hosts are cut into their suffixes and joined with the rules by equality, so rules may be as
    many as they like; only distinct hosts are cut.
    """
    labels = F.split("host", r"\.")
    suffix = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    cut = hosts.select("host").where("host <> ''").distinct().withColumn("suffix", F.explode(suffix))
    named = rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), "verdict").distinct()
    return cut.join(named, "suffix").groupBy("host").agg(
        F.collect_set(
            F.struct(
                (F.length("suffix") + F.length("prefix")).alias("size"),
                F.concat("suffix", "prefix").alias("rule"),
                "prefix",
                "verdict",
            )
        ).alias("candidates")
    )


def judge_urls(pages: DataFrame, rules: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, component) for each row of ``pages`` (page_id, url, html).

    The longest fitting rule decides; of equally long ones the last by text, then block. Without
    a rule: allow if an alias is explicitly allowed, else block if one is blocked, else allow.
    ``links`` (src, dst urls) adds redirects known from elsewhere. Null urls, and urls without
    ``://``, have empty host and path, no rule, no aliases, and are allowed. Rows with one url
    are all judged; other columns play no part. A very long url or html is read whole; an empty
    table gives no rows.
    """
    base = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # written, so that a hot host's pages meet a plain table: broadcast if it is small, split if not
    named = base.join(materialise(fitting_rules(base, rules), "host-rules"), "host", "left")
    best = F.array_max(F.filter("candidates", lambda r: F.col("path").startswith(r["prefix"])))
    judged = materialise(
        named.withColumn("best", best).select(
            "page_id", "url", "host", "path",
            F.col("best.rule").alias("rule"), F.col("best.verdict").alias("own"),
            canonical_url(F.col("url")).alias("node"),
        ),
        "url-rules",
    )
    # each url is its canonical spelling; links join spellings
    found = pages.select("url", F.explode(links_of(F.col("html"))).alias("target")).select(
        F.col("url").alias("src"), absolute(F.col("url"), F.col("target")).alias("dst")
    )
    if links is not None:
        found = found.unionByName(links.select("src", "dst"))
    edges = found.select(canonical_url(F.col("src")).alias("src"), canonical_url(F.col("dst")).alias("dst"))
    spelled = judged.where("node is not null").select(F.col("node").alias("dst"), F.concat(F.lit("\u0000"), "url").alias("src"))
    groups = connected_components(edges.unionByName(spelled.distinct()))
    # a component is named by its least node; a page's own node is its spelled url
    member = groups.where(F.col("node").startswith("\u0000")).select(
        F.substring("node", 2, 1 << 30).alias("url"), "component"
    )
    held = materialise(
        judged.where("own is not null").join(member, "url").groupBy("component").agg(
            F.max(F.when(F.col("own") == "allow", 1).otherwise(0)).alias("allowed")
        ),
        "component-verdicts",
    )
    inherited = member.join(held, "component").select(
        F.col("url").alias("alias"), F.when(F.col("allowed") == 1, "allow").otherwise("block").alias("passed_on")
    )
    return judged.join(inherited, judged["url"] == inherited["alias"], "left").select(
        "page_id", "url", "host", "path", "rule",
        F.coalesce("own", "passed_on", F.lit("allow")).alias("verdict"),
    )


def op7_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return judge_urls(table(spark, sf_dir, "pages"), rule_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The tables hold no redirect or canonical markup, so a component is the pages of one canonical
#: spelling. The SQL says that plainly; components over links are tested against brute force.
ORACLE_SQL = rf"""
WITH u AS (
  SELECT page_id, url,
         coalesce({_LOWER.format("regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's')")}, '') AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path,
         regexp_extract(url, '^[^?#]*\?([^#]*)', 1, 's') AS query
  FROM pages
), r(verdict, rhost, rpath) AS (
  VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}
), own AS (
  SELECT u.page_id, u.url, u.host, u.path,
         arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
         arg_max(r.verdict, length(rhost || rpath)) AS own,
         CASE WHEN u.host <> '' THEN regexp_replace(u.host, '^www\.', '') || regexp_replace(u.path, '/+$', '') ||
           CASE WHEN regexp_replace(regexp_replace(u.query, '(^|&)({TRACKING})=[^&]*', '', 'g'), '^&', '') <> ''
                THEN '?' || regexp_replace(regexp_replace(u.query, '(^|&)({TRACKING})=[^&]*', '', 'g'), '^&', '') ELSE '' END END AS node
  FROM u LEFT JOIN r ON (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath)
  GROUP BY ALL
), passed AS (
  SELECT node, CASE WHEN bool_or(own = 'allow') THEN 'allow' ELSE 'block' END AS passed_on
  FROM own WHERE own IS NOT NULL AND node IS NOT NULL GROUP BY node
)
SELECT page_id, host, path, rule, coalesce(own, passed_on, 'allow') AS verdict
FROM own LEFT JOIN passed USING (node)
"""
