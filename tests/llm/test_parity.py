"""The parity-sketch join against comparing all pairs."""

import random

import numpy as np
from helpers import AWKWARD, documents, frame, words

from tickerloom.llm import op13_parity as op
from tickerloom.llm import sieve


def brute(rows, n=5, similarity=80):
    """{row: (size, component)} by comparing all pairs of sets with integers."""
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, s in enumerate(sets):
        met = {}
        for x in s:
            for j in holders[x]:
                if j > i:
                    met[j] = met.get(j, 0) + 1
        for j, both in met.items():
            if 100 * both >= similarity * (len(s) + len(sets[j]) - both):
                label[root(j)] = root(i)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(doc)
    least = {r: min((x for x in own if x is not None), default=None) for r, own in ids.items()}
    return sorted(((doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_query_equals_all_pairs(spark, sf):
    docs = documents(sf)
    assert got(op.op13_parity_join(spark, sf)) == brute(list(zip(docs["doc_id"].tolist(), docs["text"], strict=True)))


def families(seed):
    """Originals of many sizes, chains of edited copies, families and texts around one shared passage."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(4000)}"
    texts = []
    for size in (1, 4, 5, 6, 9, 12, 20, 36, 37, 60, 90, 150, 400, 1500):
        for _ in range(3):
            own = [word() for _ in range(size)]
            texts.append(own)
            for _ in range(6):  # each an edit of the one before
                own = list(own)
                for _ in range(rnd.randrange(1, 2 + size // 60)):
                    k = rnd.randrange(len(own))
                    own[k : k + rnd.randrange(2)] = [word()] * rnd.randrange(1, 3)
                texts.append(own)
    shared = [word() for _ in range(120)]
    texts += [[word() for _ in range(rnd.randrange(10, 90))] + shared + [word() for _ in range(rnd.randrange(30))] for _ in range(80)]
    family = [word() for _ in range(200)]
    for _ in range(80):
        own = list(family)
        own[rnd.randrange(200)] = word()
        texts.append(own)
    rnd.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_edited_copies_families_and_shared_passages(spark):
    rows = families(1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(op.jaccard_components(df)) == brute(rows)


def test_small_cells_and_a_sieve_that_lets_all_through_change_nothing(spark, monkeypatch):
    rows = families(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("c", op.content(op.F.col("text")))
    keyed = op.materialise(op.keyed_sets(docs, 5, 0.8), "test-keyed")
    monkeypatch.setattr(sieve, "SIEVE_BITS", 1 << 15)
    found = keyed.where("own").join(op.similar_sets(docs, keyed, 5, 0.8, cell=3, rounds=1), "name", "left")
    groups = {}
    for r in found.collect():
        groups.setdefault(r["root"] if r["root"] is not None else bytes(r["name"]), []).append(r["doc_id"])
    want = {}
    for doc, _, component in brute(rows):
        want.setdefault(component, []).append(doc)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_keys_are_counted_in_packs_without_a_row_for_each(spark):
    """Copies share no key with another set; a key of many sets counts all; packs of any size agree."""
    rnd = random.Random(8)
    rows = [(bytes([i % 40]), 0 if i % 40 else -1, 3, [rnd.choice((7, -7, 1 << 62, -(1 << 62))), i % 40, -(i % 20), rnd.getrandbits(62)] if i % 40 else []) for i in range(200)]
    want = {}
    for name, _, _, keys in rows:
        for key in keys:
            want.setdefault(key, []).append(name)
    want = {k: len(x) for k, x in want.items() if len(set(x)) > 1}
    keyed = spark.createDataFrame(rows, "name binary, band int, n int, keys array<long>").repartition(3)
    for bucket in (5, 1 << 20):
        df = op.shared_keys(keyed, bucket)
        assert {r["key"]: r["often"] for r in df.collect()} == want
        assert "Generate" not in df._jdf.queryExecution().toString()
    assert not op.shared_keys(keyed.limit(0)).collect()


def test_sketches_differ_in_no_more_parts_than_sets_do():
    rng = np.random.default_rng(5)
    for n in (3, 30, 31, 32, 33, 60, 200, 3000):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
            k = rng.integers(0, 1 + n // 9)
            b = np.unique(np.concatenate((a[k:], rng.integers(0, 1 << 63, rng.integers(0, 1 + n // 9), np.uint64))))
            both = len(np.intersect1d(a, b))
            if 10 * both < 8 * (len(a) + len(b) - both):
                continue
            mine = {band: (apart, set(keys.tolist())) for band, apart, keys in op.sketches(a, 0.8)}
            his = {band: (apart, set(keys.tolist())) for band, apart, keys in op.sketches(b, 0.8)}
            assert any(
                len(mine[x][1] & his[x][1]) >= 1 and len(mine[x][1] - his[x][1]) <= min(mine[x][0], his[x][0]) for x in mine.keys() & his.keys()
            )


def test_parity_bits_bound_the_difference(spark):
    rng = np.random.default_rng(6)
    a = np.unique(rng.integers(0, 1 << 63, 500, np.uint64))
    b = np.unique(np.concatenate((a[40:], rng.integers(0, 1 << 63, 900, np.uint64))))
    df = spark.createDataFrame([(op.parity_bits(a).tolist(), op.parity_bits(b).tolist())], "x array<long>, y array<long>")
    assert df.select(op.bits_apart("x", "y")).first()[0] <= len(np.setxor1d(a, b))


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in AWKWARD]
    want = brute(rows)
    assert got(op.jaccard_components(frame(spark))) == [
        (doc, n, c if n else doc) for doc, n, c in want
    ]
    assert not op.jaccard_components(frame(spark, rows=[])).collect()


def test_ids_that_are_null_name_nothing_but_themselves(spark):
    text = "one two three four five six seven"
    rows = [(None, text), (9, text), (None, "another text that is alone in here"), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(op.jaccard_components(df)) == sorted([(None, 3, 9), (9, 3, 9), (None, 3, None), (None, 0, None), (3, 0, 3)], key=str)
