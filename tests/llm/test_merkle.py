"""Merkle proofs against a plain tree, and against SQL."""

import zlib
from hashlib import sha256

import pytest
from compare import differences
from helpers import documents, frame

from pyspark.sql import functions as F
from tickerloom.llm import op11_merkle as op


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_paths(nodes):
    """(root, [[(side, sibling) a level] a node]) of a list, level by level over the whole of it."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            j = i ^ 1
            paths[k].append(("l" if j < i else "r", nodes[j]) if j < len(nodes) else ("n", ""))
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        at = [i // 2 for i in at]
    return nodes[0], paths


def brute(rows):
    """rows (group, doc_id, leaf, changed) to the operator's rows."""
    trees = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2])):
        trees.setdefault(r[0], []).append(r)
    subs = [plain_paths([r[2] for r in own]) for own in trees.values()]
    if not subs:
        return []
    root, upper = plain_paths([s for s, _ in subs])
    out = []
    for (sub, paths), up, own in zip(subs, upper, trees.values(), strict=True):
        for path, r in zip(paths, own, strict=True):
            x = r[3] or r[2]
            for side, other in path + up:
                x = h(other, x) if side == "l" else h(x, other)
            out.append((r[1], r[2], sub, root, h(*[o for _, o in path + up]), x, x == root))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()), key=str)


def plain_leaf(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def test_query_matches_a_plain_tree(spark, sf):
    rows = []
    for d in documents(sf).itertuples():
        leaf = plain_leaf(d.doc_id, d.source, d.lang, d.n_chars, d.text)
        hit = zlib.crc32(str(d.doc_id).encode()) % 7 == 0
        rows.append((d.lang, d.doc_id, leaf, plain_leaf(d.doc_id, d.source, d.lang, d.n_chars + 1, d.text) if hit else None))
    assert got(op.op11_merkle_exchange(spark, sf)) == brute(rows)


def test_matches_sql(spark, sf, con):
    assert differences(op.op11_merkle_exchange(spark, sf).toPandas(), op.ORACLE_SQL, con) == ""


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_superblocks_of_any_size_give_the_same_tree(spark, bits):
    sizes = {None: 1, "a": 2, "b": 3, "c": 4, "d": 5, "e": 9, "é": 17, "f": 33}
    rows = [(g, i * 3, h(str(g), str(i)), h("x") if i % 4 == 1 else None) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "lang string, doc_id long, leaf string, changed string").repartition(5)
    assert got(op.merkle_proofs(df, bits=bits)) == brute(rows)


def test_one_leaf_one_group_repeats_and_nothing(spark):
    make = lambda rows: spark.createDataFrame(rows, "lang string, doc_id long, leaf string, changed string")
    one = [("en", 1, h("a"), None)]
    assert got(op.merkle_proofs(make(one))) == brute(one)
    assert got(op.merkle_proofs(make(one)))[0][2:5] == (h("a"), h("a"), h(""))
    many = [("en", None, h("a"), None)] * 7 + [("en", None, h("b"), h("c"))] * 2 + [("en", 4, h("a"), None)] * 3
    assert got(op.merkle_proofs(make(many), bits=1)) == brute(many)
    assert not op.merkle_proofs(make([])).collect()


def test_awkward_rows_and_clashing_columns(spark):
    df = frame(spark)
    rows = [(r.lang, r.doc_id, plain_leaf(r.doc_id, r.source, r.lang, r.n_chars, r.text), None) for r in df.collect()]
    leaves = op.document_leaves(df, F.lit(False))
    assert got(op.merkle_proofs(leaves)) == brute(rows)
    kept = {r["lang"]: r["rows"] for r in op.manifest(leaves).collect()}
    assert sum(kept.values()) == df.count() and kept[None] == df.where("lang is null").count()


def test_tampering_with_a_null_stays_unseen_and_any_change_is_found(spark):
    df = frame(spark).withColumn("n_chars", F.when(F.col("lang") == "en", F.lit(5)).cast("long"))
    rows = op.merkle_proofs(op.document_leaves(df, F.lit(True))).join(df.select("doc_id", "lang").distinct(), "doc_id").collect()
    assert rows and all(r["verified"] == (r["lang"] != "en") for r in rows)
