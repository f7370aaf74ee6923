"""Dynamic itemset counting against counting every window."""

import collections
import re

import numpy as np
import pytest
from compare import differences
from helpers import documents, frame

from tickerloom.llm import op12_collocations as op


def brute(rows, longest=3, threshold=10, covered=50, first=2000):
    """rows (lang, text) to the operator's rows, with Python's integers."""
    f = collections.Counter()
    total = collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        lower = (text or "").encode().lower().decode()
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    out = collections.defaultdict(list)
    held = {p for p, n in f.items() if len(p) > 2 and n >= threshold}
    for p in held:
        lang, *w = p
        inside = lambda q: len(q) > len(p) and q[0] == lang and any(list(q[i : i + len(w)]) == w for i in range(1, len(q) - len(w) + 1))
        if any(inside(q) and 100 * f[q] >= covered * f[p] for q in held):
            continue
        cuts = [(1_000_000 * f[p] ** 2 // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out[lang].append((-score, -f[p], " ".join(w).encode(), left, right))
    return sorted(
        (lang, i, phrase.decode(), -a, left, right, total[lang], -score)
        for lang, own in out.items() for i, (score, a, phrase, left, right) in enumerate(sorted(own)[:first], 1)
    )


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def test_query_matches_sql(spark, sf, con):
    df = op.op12_dynamic_itemsets(spark, sf)
    assert [t for c, t in df.dtypes if c not in ("lang", "phrase")] == ["bigint"] * 6
    assert differences(df.toPandas(), op.ORACLE_SQL, con) == ""


@pytest.mark.parametrize(("shards", "longest"), [(1, 2), (3, 4)])
def test_any_shards_and_lengths_match_brute_force(spark, sf, shards, longest):
    docs = documents(sf)
    rows = list(zip(docs["lang"], docs["text"], strict=True))[:80]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    s = op.Settings(shards=shards, longest=longest, threshold=4, block_bytes=20_000, first=500)
    assert got(op.collocations(df, s)) == brute(rows, longest, 4, 50, 500)


def test_late_phrases_and_cuts(spark):
    rows = [("en", "red apple pie. red apple! Red  Apple\tpie, ripe apple pie")] * 3 + [(None, "a b a b a b a")] * 4 + [("und", "a b\nc")] + [("de", None), ("de", ""), ("fr", "é.é.é")]
    rows += [("en", f"only here {i} {i}") for i in range(5)]
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    s = op.Settings(threshold=3, block_bytes=30)
    assert got(op.collocations(df, s)) == brute(rows, 3, 3)


def test_products_beyond_64_bits(spark):
    expr = "(1000000BD * cast(a as decimal(19,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    a, left, right = 10**15 + 7, 10**15 + 9, 3 * 10**15 + 1
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.selectExpr(expr).first()[0] == 1_000_000 * a * a // (left * right)


def test_awkward_rows(spark):
    df = frame(spark)
    rows = [(r.lang, r.text) for r in df.collect()]
    assert got(op.collocations(df)) == brute(rows)
    assert not op.collocations(frame(spark, rows=[])).collect()


def test_pairs_are_packed_and_summed_in_ranges(monkeypatch):
    rng = np.random.default_rng(1)
    words, n = [rng.integers(0, 30, 2000) << 40 | 1 for _ in range(2)], rng.integers(1, 9, 2000)
    want = collections.Counter()
    for a, b, k in zip(*words, n, strict=True):
        want[a, b] += k
    places, packs = op.pack_pairs(words, n, 7)
    assert places.tolist() == list(range(7)) and 24 * 2000 == sum(map(len, packs))
    summed = [op.sum_pairs([pack, pack]).T.tolist() for pack in packs]
    assert sorted((a, b, k) for own in summed for a, b, k in own) == sorted((a, b, 2 * k) for (a, b), k in want.items())
    monkeypatch.setattr(op, "_key", lambda w: np.zeros(len(w[0]), np.int64))  # all pairs have one hash
    assert sorted(op.sum_pairs(packs).T.tolist()) == sorted([a, b, k] for (a, b), k in want.items())


def test_many_ranges_match_brute_force(spark, sf):
    docs = documents(sf)
    rows = list(zip(docs["lang"], docs["text"], strict=True))[:60]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    assert got(op.collocations(df, op.Settings(threshold=4, block_bytes=20_000, range_words=500))) == brute(rows, 3, 4)
