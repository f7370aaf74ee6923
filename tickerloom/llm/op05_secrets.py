"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the sha256 of its content. The ledger is a Parquet
table with one row for each (blob, rule version) ever scanned, clean blobs included. A run scans
only the pairs that are not in it, one path's copy of each blob, appends the results, and joins
them back to all paths that hold the blob.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, map_arrow, materialise, remove, scratch, table

BASE_KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class Rule:
    """``needles``: one of them is in the lower-cased text of every match (empty: always try)."""

    kind: str
    pattern: re.Pattern
    needles: tuple[str, ...] = ()
    group: int = 0
    least: int = 0


#: The base kinds' formats, and three public credential formats.
RULES = (
    Rule(
        "assign",
        re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        2,
        6,
    ),
    Rule("access", re.compile(r"AKIA[A-Z0-9]+"), ("akia",), 0, 20),
    Rule("hex", re.compile(r"[0-9a-f]{24,}")),  # a run is maximal, so its length may be asked at once
    Rule("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\t\n\r\x20]*(?:-----END [A-Z ]*PRIVATE KEY-----)?"), ("private key-----",)),
    Rule("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), ("eyj",)),
    Rule("bearer", re.compile(r"Bearer\x20+[A-Za-z0-9._~+/-]{16,}=*"), ("bearer",)),
)


@dataclass(frozen=True)
class RuleSet:
    """Rules under a version name; a changed rule needs a new version, so blobs are rescanned."""

    version: str = "2024-1"
    rules: tuple[Rule, ...] = field(default=RULES)

    def kinds(self) -> list[str]:
        return [r.kind for r in self.rules]


def scan(text: str, rules: tuple[Rule, ...]) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) in code points, rule by rule, leftmost and non-overlapping in each."""
    low = text.lower()
    for rule in rules:
        if not rule.needles or any(n in low for n in rule.needles):
            for m in rule.pattern.finditer(text):
                if len(m[rule.group]) >= rule.least:
                    yield rule.kind, m.start(), m.end()


FINDINGS = "array<struct<kind:string,start:int,end:int>>"


def blob_versions(df: DataFrame, path: str, text: str, revision: str | None = None) -> DataFrame:
    """(path, revision, blob_id, size, text): every historical version, content-addressed.

    A null text is the empty blob; without a revision column it is null.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        F.col(path).alias("path"),
        (F.col(revision) if revision else F.lit(None).cast("string")).alias("revision"),
        F.sha2(body.cast("binary"), 256).alias("blob_id"),
        body.alias("text"),
    )


class BlobLedger:
    """The ledger in one folder, with a folder below for each rule version; without a folder, a
    new one in the shared folder.

    ``update`` may be run again after a failure: what it appended is not scanned again, and a
    pair that is in the ledger twice (two runs at once) is read once.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "blob-ledger")
        self.schema = f"blob_id string, rule_version string, findings {FINDINGS}"

    def read(self, version: str) -> DataFrame:
        """(blob_id, findings) of one rule version; empty if nothing has been scanned yet."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], self.schema).drop("rule_version")
        rows = self.spark.read.schema(self.schema).parquet(self.path).where(F.col("rule_version") == version)
        return rows.select("blob_id", "findings").dropDuplicates(["blob_id"])

    def unseen(self, versions: DataFrame, version: str) -> DataFrame:
        """One holder for each blob not yet scanned: (blob_id, path, revision, copies).

        The holder is found by a ``min`` with map-side combine, so a blob that a third of all
        paths hold costs a task one row a partition; texts are not shuffled for it. ``copies`` is
        how many equal rows the holder has.
        """
        holders = versions.groupBy("blob_id", "path", "revision").agg(F.count(F.lit(1)).alias("copies"))
        holders = holders.groupBy("blob_id").agg(F.min(F.struct("path", "revision", "copies")).alias("h"))
        return holders.join(self.read(version), "blob_id", "left_anti").select("blob_id", "h.path", "h.revision", "h.copies")

    def update(self, versions: DataFrame, rules: RuleSet = RuleSet()) -> int:
        """Scan unseen (blob, rule version) pairs, each blob once, and append them; returns how many."""
        with scratch(self.spark):
            todo = materialise(self.unseen(versions, rules.version), "unseen-blobs")
            n = todo.count()
            if n:
                wanted = todo.select(
                    F.col("blob_id").alias("b"), F.col("path").alias("p"), F.col("revision").alias("r"), "copies"
                )
                same = (F.col("blob_id") == F.col("b")) & F.col("path").eqNullSafe(F.col("p")) & F.col("revision").eqNullSafe(F.col("r"))
                held = lambda which: versions.join(wanted.where(which), same, "left_semi").select("blob_id", "text")
                one = held("copies = 1")
                if todo.where("copies > 1").limit(1).count():
                    one = one.unionByName(held("copies > 1").dropDuplicates(["blob_id"]))
                scanned = map_arrow(one, f"blob_id string, findings {FINDINGS}", _scanner(rules.rules))
                scanned.select("blob_id", F.lit(rules.version).alias("rule_version"), "findings").write.mode("append").partitionBy("rule_version").parquet(self.path)
        return n

    def findings(self, versions: DataFrame, rules: RuleSet = RuleSet()) -> DataFrame:
        """(path, revision, blob_id, findings) for every version of every path.

        Only blobs with findings are joined: they are written first, so the planner knows their
        size, and as both sides are then plain shuffles, AQE splits a hot blob's partition. A
        version without a row there is clean, as ``update`` has scanned them all.
        """
        hits = materialise(self.read(rules.version).where(F.size("findings") > 0), "findings", keep=True)
        none = F.array().cast(FINDINGS)
        return (
            versions.select("path", "revision", "blob_id")
            .join(hits, "blob_id", "left")
            .withColumn("findings", F.coalesce("findings", none))
        )


def _scanner(rules: tuple[Rule, ...]):
    def rows(batch: pa.RecordBatch) -> dict[str, list]:
        found = [
            [{"kind": k, "start": a, "end": b} for k, a, b in scan(t.as_py(), rules)]
            for t in batch.column("text")
        ]
        return {"blob_id": batch.column("blob_id"), "findings": found}

    return rows


def scan_secrets(df: DataFrame, path: str, text: str, revision: str | None = None, rules: RuleSet = RuleSet(), ledger: str | None = None) -> DataFrame:
    """Findings of every version: (path, revision, blob_id, findings), through the ledger.

    Empty and null texts give no findings; repeated rows come back as often as they are, but a
    blob is scanned once; a very long text is scanned whole; two versions of a path with one
    revision are two versions; an empty table gives an empty result; other columns of ``df`` play
    no part. Without a ``ledger`` a new one is made, and removed at the end.
    """
    versions = blob_versions(df, path, text, revision)
    book = BlobLedger(df.sparkSession, ledger)
    book.update(versions, rules)
    found = book.findings(versions, rules)
    if ledger is None:
        remove(df.sparkSession, book.path)
    return found


def span_text(findings: str, kinds: list[str], only: tuple[str, ...] | None = None):
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    c = F.col(findings)
    if only:
        c = F.filter(c, lambda x: x["kind"].isin(*only))
    rank = F.array(*[F.lit(k) for k in kinds])
    ordered = F.array_sort(
        F.transform(c, lambda x: F.struct(x["start"].alias("s"), F.array_position(rank, x["kind"]).alias("k"), x["end"].alias("e"), x["kind"].alias("n")))
    )
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["n"], x["s"], x["e"])), ",")


def op5_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of documents; doc_id is the path, the row its one version."""
    rules = RuleSet()
    found = scan_secrets(table(spark, sf_dir, "documents"), "doc_id", "text", rules=rules)
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("path").alias("doc_id"),
        *[count(k) for k in BASE_KINDS],
        F.sha2(span_text("findings", rules.kinds(), BASE_KINDS).cast("binary"), 256).alias("base_sha256"),
        span_text("findings", rules.kinds()).alias("spans"),
    )


def _letters(word: str) -> str:
    """A word in either case, spelled out: folding would also take other alphabets' letters."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _found_sql(place: int, rule: Rule) -> str:
    pattern = rule.pattern.pattern.replace("'", "''")
    if rule.pattern.flags & re.I:
        start, rest = pattern.split(")", 1)
        pattern = f"({'|'.join(_letters(w) for w in start[1:].split('|'))}){rest}"
    return f"""SELECT row, {place} AS k, '{rule.kind}' AS kind,
      unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
        a := list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
        n := length(m[i]), own := length(g[i])))) AS f
      FROM (SELECT row, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g, string_split_regex(t, '{pattern}') AS s FROM d)
      WHERE len(m) > 0"""


def _spans_sql(where: str = "true") -> str:
    return f"coalesce(string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, k) FILTER ({where}), '')"


#: A match starts after the pieces and matches before it.
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT row, k, kind, CAST(f.a AS BIGINT) AS a, CAST(f.a + f.n AS BIGINT) AS e, f.own
  FROM ({' UNION ALL '.join(_found_sql(i, r) for i, r in enumerate(RULES))})
), kept AS (SELECT * FROM found WHERE own >= CASE kind {' '.join(f"WHEN '{r.kind}' THEN {r.least}" for r in RULES)} END)
SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)},
       sha256({_spans_sql("kind IN ('assign', 'access', 'hex')")}) AS base_sha256, {_spans_sql()} AS spans
FROM d LEFT JOIN kept USING (row) GROUP BY row, doc_id
"""
