import hashlib
import re

from compare import differences
from helpers import documents, frame

from tickerloom.llm import op05_secrets as s

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def plain(text):
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda f: (f[1], s.BASE_KINDS.index(f[0])))


TRICKY = [
    (1, 'Password: "abcdef" API_KEY=xyz12 apikey = abc123', None, None),
    (2, "AKIA" + "A" * 15 + " AKIAAKIA" + "B" * 16, None, None),
    (3, "é token=" + "a1" * 12 + " " + "f" * 23, None, None),
    (4, "tokentoken=abcdefg secret:secret:abcdefg ſecret=abcdefg", None, None),
    (5, "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", None, None),
]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def check(rows, texts):
    for r in rows:
        want = plain(texts[r.doc_id] or "")
        assert r.base_sha256 == digest(want), r
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in want) for kind in s.BASE_KINDS)
        kept = set(r.spans.split(",")) if r.spans else set()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= kept


def test_matches_plain(spark, sf):
    docs = documents(sf)
    rows = s.op5_blob_ledger(spark, sf).collect()
    assert len(rows) == len(docs)
    check(rows, dict(zip(docs.doc_id, docs.text, strict=True)))


def test_tricky_matches(spark, tmp_path):
    frame(spark, TRICKY).write.parquet(str(tmp_path / "documents.parquet"))
    rows = s.op5_blob_ledger(spark, str(tmp_path)).collect()
    check(rows, {r[0]: r[1] for r in TRICKY})
    assert "pem:0:" in next(r.spans for r in rows if r.doc_id == 5)


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    book = s.BlobLedger(spark, f"file://{tmp_path}/ledger")
    first = s.blob_versions(frame(spark, TRICKY), "doc_id", "text")
    assert book.update(first) == 5
    assert book.update(first) == 0
    more = s.blob_versions(frame(spark, [*TRICKY, (9, "new token=abcdefgh", None, None), (10, TRICKY[0][1], None, None)]), "doc_id", "text")
    assert book.update(more) == 1  # doc 10 holds a known blob
    assert book.update(more, s.RuleSet(version="next")) == 6
    assert book.findings(more).count() == 7
    assert {r.path for r in book.findings(more).collect() if r.findings} >= {1, 9, 10}


def test_revisions_are_versions(spark, tmp_path):
    df = spark.createDataFrame([("a", "r1", "token=abcdefgh"), ("a", "r2", "clean"), ("b", "r1", "token=abcdefgh")], "path string, rev string, body string")
    got = s.scan_secrets(df, "path", "body", "rev").collect()
    assert sorted((r.path, r.revision, len(r.findings)) for r in got) == [("a", "r1", 1), ("a", "r2", 0), ("b", "r1", 1)]


def test_awkward_rows(spark):
    assert s.scan_secrets(frame(spark), "doc_id", "text").count() == 10
    assert s.scan_secrets(frame(spark).limit(0), "doc_id", "text").count() == 0


def test_equal_rows_are_scanned_once(spark, tmp_path):
    book = s.BlobLedger(spark, f"file://{tmp_path}/ledger")
    rows = s.blob_versions(frame(spark, [(1, "token=abcdefgh", None, None)] * 1000 + [(2, "token=abcdefgh", None, None)]), "doc_id", "text")
    assert book.update(rows) == 1 and spark.read.parquet(book.path).count() == 1
    got = book.findings(rows).collect()
    assert len(got) == 1001 and all([(f.kind, f.start, f.end) for f in r.findings] == [("assign", 0, 14)] for r in got)


def test_kinds_of_the_method(spark):
    jwt, bearer = "eyJ" + "a" * 10 + ".eyJ" + "b" * 10 + "." + "c" * 10, "Bearer " + "x" * 20 + "=="
    texts = {1: f"é {jwt} {bearer}.", 2: jwt[:-5] + " Bearer short", 3: "-----BEGIN PRIVATE KEY-----\nMIIB\n-----END PRIVATE KEY----- tail", 4: "-----BEGIN EC PRIVATE KEY-----\ncut off"}
    got = {r.path: [(f.kind, f.start, f.end) for f in r.findings] for r in s.scan_secrets(frame(spark, [(i, t, None, None) for i, t in texts.items()]), "doc_id", "text").collect()}
    at = texts[1].index("Bearer")
    assert got == {1: [("jwt", 2, 2 + len(jwt)), ("bearer", at, at + len(bearer))], 2: [], 3: [("pem", 0, len(texts[3]) - 5)], 4: [("pem", 0, len(texts[4]))]}


def test_matches_sql(spark, sf, con):
    assert differences(s.op5_blob_ledger(spark, sf).toPandas(), s.ORACLE_SQL, con) == ""
