import re
from urllib.parse import urljoin

from compare import differences

from tickerloom.llm import op07_urls as u


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_matches_sql(spark, sf, con):
    assert differences(u.op7_redirect_equivalence(spark, sf).toPandas(), u.ORACLE_SQL, con) == ""


def split(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].lower(), m[2]) if m else ("", "")


CASES = [
    (1, "https://a.example.com/de/1", None),  # blocked
    (2, "http://b.example.org/x", '<link rel="canonical" href="https://a.example.com/de/1">'),  # its alias
    (3, "http://c.example.org/y", '<meta http-equiv="refresh" content="0; url=http://b.example.org/x">'),  # alias of an alias
    (4, "http://d.example.org/fr/z", "<link href='http://c.example.org/q' rel=canonical>"),  # allowed
    (5, "http://c.example.org/q/?utm_source=z", None),  # alias of an allowed page
    (6, "http://e.example.org/q", '<link rel="canonical" href="/fr/other">'),  # leads to no page
    (7, "http://x.net/", None),
    (8, "http://x.net", None),  # no path, so net/ does not fit, but a spelling of 7
    (9, "http://www.example.net/en/a", None),
    (10, "HTTP://WWW.Example.COM/de/a", None),
    (11, "http://notexample.com/de/a", None),
    (12, "http://www.c.example.org/y?ref=1", None),  # spelling of 3
    (13, None, "<link rel=canonical href=http://a.example.com/de/1>"),
    (14, "no scheme", None),
    (15, "", None),
    (16, "http://f.example.org/both", '<link rel="canonical" href="http://a.example.com/de/1"><link rel="canonical" href="http://d.example.org/fr/z">'),
]


def brute(rows):
    """Union-find over canonical spellings."""
    def spell(url):
        host, path = split(url)
        if not host:
            return None
        q = re.match(r"(?s)^[^?#]*\?([^#]*)", url)
        kept = [p for p in (q[1].split("&") if q else []) if p and not re.match(rf"({u.TRACKING})=", p)]
        return re.sub(r"^www\.", "", host) + path.rstrip("/") + ("?" + "&".join(kept) if kept else "")

    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    own = {}
    for p, url, html in rows:
        host, path = split(url)
        fit = [(len(h + r), h + r, v) for v, h, r in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(r)]
        own[p] = max(fit)[1:] if fit else (None, None)
        for tag in re.findall(r"<(?:link|meta)[^>]*>", html or ""):
            target = re.search(r"""(?:href=|url=)["']?([^"'>\s]+)""", tag)[1]
            a, b = spell(url), spell(urljoin(url or "", target)) if url else None
            if a and b:
                parent[root(a)] = root(b)
    group = {}
    for p, url, _ in rows:
        if spell(url) and own[p][1]:
            group.setdefault(root(spell(url)), set()).add(own[p][1])
    out = {}
    for p, url, _ in rows:
        shared = group.get(root(spell(url))) if spell(url) else None
        out[p] = (*split(url), own[p][0], own[p][1] or ("allow" if not shared or "allow" in shared else "block"))
    return out


def test_aliases_inherit_blocks_and_allow_wins(spark):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in u.judge_urls(pages(spark, CASES), u.rule_frame(spark)).collect()}
    assert got == brute(CASES)
    # 16 joins the blocked and the allowed component: explicit allow wins for pages without a rule
    assert [got[i][3] for i in (1, 2, 3, 12, 5)] == ["block", "allow", "allow", "allow", "allow"]


def test_aliases_without_the_bridge(spark):
    rows = CASES[:-1]
    got = {r.page_id: r.verdict for r in u.judge_urls(pages(spark, rows), u.rule_frame(spark)).collect()}
    assert [got[i] for i in (1, 2, 3, 12)] == ["block"] * 4 and got[4] == got[5] == got[6] == "allow"
    assert (got[7], got[8], got[9], got[10], got[11]) == ("block", "block", "allow", "block", "allow")
    assert got[13] == got[14] == got[15] == "allow"


def test_known_redirects_and_awkward_rows(spark):
    df = pages(spark, [(1, "http://a.example.org/1", None), (1, "http://a.example.org/1", None), (2, "http://b.net/", None)])
    links = spark.createDataFrame([("http://a.example.org/1", "http://b.net/"), (None, "x")], "src string, dst string")
    got = u.judge_urls(df.selectExpr("*", "1 as host", "2 as rule", "3 as node"), u.rule_frame(spark), links).collect()
    assert sorted((r.page_id, r.verdict) for r in got) == [(1, "block"), (1, "block"), (2, "block")]
    assert u.judge_urls(df.limit(0), u.rule_frame(spark)).count() == 0
