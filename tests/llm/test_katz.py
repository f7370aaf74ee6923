import collections
import math
import zlib
from fractions import Fraction

import numpy as np
import xxhash
from helpers import documents, frame, words
from pyspark.sql import functions as F

from tickerloom.llm import op01_katz as k


def brute(docs, train, K=5):
    """Plain Katz over (id, text) pairs."""
    texts = {d: [*words(x), b"</s>"] for d, x in docs}
    one, two, after = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for d, w in texts.items():
        if d in train:
            one.update(w)
            two.update(zip([b"<s>", *w[:-1]], w, strict=True))
    for (a, b), c in two.items():
        after[a].append((b, c))
    n, v = sum(one.values()), len(one)
    coc = lambda t: np.array([sum(c == r for c in t.values()) for r in range(1, K + 2)])
    d1, d2 = k.discounts(coc(one), K), k.discounts(coc(two), K)
    cut = lambda c, d: c * (d[c - 1] if c <= K else 1)
    mass = sum(cut(c, d1) for c in one.values())
    total = n if mass < n - 1e-9 else n + 1
    p1 = lambda w: cut(one[w], d1) / total if w in one else 1 - mass / total
    alpha, div = {}, {}
    for a, follow in after.items():
        t, kept = sum(c for _, c in follow), sum(cut(c, d2) for _, c in follow)
        div[a] = t if kept < t - 1e-9 else t + 1
        alpha[a] = (1 - kept / div[a]) / (1 - sum(p1(b) for b, _ in follow))
    p2 = lambda w, a: cut(two[a, w], d2) / div[a] if (a, w) in two else alpha.get(a, 1) * p1(w)
    out = {}
    for d, w in texts.items():
        out[d] = (
            len(w), sum(x in one for x in w), sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w),
            sum(math.log10(p2(x, a)) for a, x in zip([b"<s>", *w[:-1]], w, strict=True)),
        )
    sums = [sum(p2(w, a) for w in one) + p2(b"\0unseen", a) for a in list(after)[:50]]
    return out, n, sums


def test_matches_brute_force_and_sums_to_one(spark, sf):
    got = k.op1_katz_backoff(spark, sf).toPandas().set_index("doc_id")
    docs = documents(sf)
    held = {d for d in docs.doc_id if zlib.crc32(str(d).encode()) % 7 == 2}
    want, n, sums = brute(zip(docs.doc_id, docs.text, strict=True), set(docs.doc_id) - held)
    assert np.allclose(sums, 1, atol=1e-9)
    assert len(got) == len(docs) and (got.train_tokens == n).all()
    for d, (tokens, known, base, score) in want.items():
        g = got.loc[d]
        assert (g.n_tokens, g.n_known, bool(g.held_out)) == (tokens, known, d in held)
        assert math.isclose(g.base_score, base, rel_tol=1e-9) and math.isclose(g.score, score, rel_tol=1e-9)
    # what it is for: it predicts held-out text better than the base
    assert got[got.held_out].score.sum() > got[got.held_out].base_score.sum()


def test_chunks_and_buckets_do_not_matter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", (F.col("doc_id") % 3 != 0).alias("train"))
    a, _ = k.score_texts(docs, "train")
    b, _ = k.score_texts(docs.repartition(3), "train", k.Settings(chunk_bytes=20_000, columns=3, buckets=7))
    x, y = (d.toPandas().sort_values("doc_id").reset_index(drop=True) for d in (a, b))
    assert np.allclose(x.score, y.score) and x.doc_id.equals(y.doc_id)


def test_awkward_rows(spark):
    got, model = k.score_texts(frame(spark).withColumn("train", F.lit(True)), "train")
    rows = got.collect()
    assert len(rows) == 10 and sum(r.doc_id is None for r in rows) == 1
    one = {r.doc_id: r for r in rows}
    assert one[1].n_tokens == one[2].n_tokens == one[3].n_tokens == 1
    assert one[6].n_tokens == 60_001 and all(math.isfinite(r.score) for r in rows)


def test_nothing_to_learn_from(spark):
    got, model = k.score_texts(frame(spark).withColumn("train", F.lit(False)), "train")
    assert {(r.n_known, r.base_score, r.score) for r in got.collect()} == {(0, 0.0, 0.0)}
    empty, _ = k.score_texts(frame(spark).limit(0).withColumn("train", F.lit(True)), "train")
    assert empty.count() == 0


def test_discounts_are_good_turing():
    """Against r* = (r + 1) n[r + 1] / n[r], renormalised so that counts over k keep theirs."""
    n, K = [1000, 350, 170, 100, 65, 48], 5
    got = k.discounts(np.array(n), K)
    top = Fraction((K + 1) * n[K], n[0])
    for r in range(1, K + 1):
        star = Fraction((r + 1) * n[r], n[r - 1])
        assert math.isclose(got[r - 1], (star / r - top) / (1 - top), rel_tol=1e-12)
    # what all discounts free is the mass of what was seen once
    assert math.isclose(sum((1 - got[r - 1]) * r * n[r - 1] for r in range(1, K + 1)), n[0], rel_tol=1e-12)


def test_tables_are_rows(spark):
    texts = [(1, "a b a b", True), (2, "b a", True), (3, "zz", False)]
    _, model = k.score_texts(spark.createDataFrame(texts, "doc_id long, text string, train boolean"), "train")
    word = {r.hash: r for r in model.rows(spark, "unigram").collect()}
    key = lambda w: int(np.uint64(xxhash.xxh64_intdigest(w)).astype(np.int64))
    assert {w: word[key(w)]["count"] for w in (b"a", b"b", k.END)} == {b"a": 3, b"b": 3, k.END: 2} and len(word) == 3
    ids = {r.word: w for w in (b"a", b"b", k.END) for r in [word[key(w)]]} | {0: None}
    pairs = {(ids[r.context], ids[r.word]): r["count"] for r in model.rows(spark, "bigram").collect()}
    assert pairs == {(None, b"a"): 1, (None, b"b"): 1, (b"a", b"b"): 2, (b"b", b"a"): 2, (b"b", k.END): 1, (b"a", k.END): 1}
    contexts = {ids[r.context]: r["count"] for r in model.rows(spark, "backoff").collect()}
    assert contexts == {None: 2, b"a": 3, b"b": 3}


def test_blocks_round_trip():
    arrays = [np.arange(5, dtype=np.int64), np.array([], np.int32), np.array([-1, 2 ** 40]), np.array([0.5, -2.0]), np.array([True, False])]
    for a, b in zip(arrays, k.unpack(k.pack(*arrays)), strict=True):
        assert a.tolist() == b.tolist()
