from itertools import combinations

import pytest
from helpers import AWKWARD, documents, frame, words

import corpus_pipeline as cp
from tickerloom.llm import resemblance as r


def plain_heads(rows):
    """The (doc_id, text) that stay, by comparing all pairs; every doc_id is named."""

    def grams(text):
        w = words(text)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    own, group = {d: grams(t) for d, t in rows}, {d: d for d, _ in rows}

    def root(d):
        return d if group[d] == d else root(group[d])

    for a, b in combinations(own, 2):
        x, y = own[a], own[b]
        small, large = sorted((len(x), len(y)))
        if 5 * small >= 4 * large and 5 * len(x & y) >= 4 * len(x | y):
            low, high = sorted((root(a), root(b)))
            group[high] = low
    return {d for d in own if root(d) == d}


def edited(base, *places):
    return " ".join("x" + w if i in places else w for i, w in enumerate(base))


BASE = [f"w{i}" for i in range(104)]  # 100 shingles; an edit inside changes five


def test_edited_copies_far_apart_in_bits_go(spark, sf):
    rows = [(1, edited(BASE), "en", "s"), (2, edited(BASE, 20, 70), "en", "s"), (3, edited(BASE, 20, 50, 70), "en", "s")]
    got = {x.doc_id for x in cp.near_dedup(spark, frame(spark, rows), sf).collect()}
    # 85 of 115 with the first are too few, but 95 of 105 with the second
    assert got == plain_heads([(d, t) for d, t, *_ in rows]) == {1}


def test_the_limit_itself_counts(spark, sf):
    pair = lambda k: [(1, " ".join(BASE[:49]), "en", "s"), (2, " ".join(BASE[:49 - k]), "en", "s")]  # noqa: E731  45 and 45 - k shingles
    assert {x.doc_id for x in cp.near_dedup(spark, frame(spark, pair(9)), sf).collect()} == {1}
    assert {x.doc_id for x in cp.near_dedup(spark, frame(spark, pair(10)), sf).collect()} == {1, 2}


@pytest.mark.parametrize("cell", [256, 3])
def test_families_are_whole(spark, cell):
    """A chain of edits, whose ends are not similar, and a family all of whose members are."""
    chain = [(i, edited([f"c{w}" for w in range(104)], *range(0, 4 * i, 4)), "en", "s") for i in range(1, 20)]
    family = [(100 + i, edited(BASE, i), "en", "s") for i in range(30)]
    docs = frame(spark, chain + family)
    keyed = r.keyed_sets(docs.select("doc_id", r.content(r.F.col("text")).alias("c"), "text"), 5, 0.8)
    groups = {bytes(x.name): x.root for x in r.similar_sets(docs, r.materialise(keyed, "keyed"), 5, 0.8, cell=cell).collect()}
    of = {x.doc_id: groups.get(bytes(x.name), bytes(x.name)) for x in keyed.where("own").collect()}
    heads = {min(d for d in of if of[d] == g) for g in set(of.values())}
    assert heads == plain_heads([(d, t) for d, t, *_ in chain + family])


def test_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = documents(sf)
    got = {x.doc_id for x in r.one_of_each(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == plain_heads(list(zip(docs.doc_id, docs.text, strict=True)))


def test_rows_without_id(spark, sf):
    a, b = edited(BASE), " ".join(f"v{i}" for i in range(60))
    rows = [(None, a, "en", "s"), (None, edited(BASE, 50), "en", "s"), (7, edited([f"v{i}" for i in range(60)], 0), "en", "s"), (None, b, "en", "s"), (None, b, "en", "s")]
    got = [(x.doc_id, x.text) for x in cp.near_dedup(spark, frame(spark, rows), sf).collect()]
    assert len(got) == 2 and got.count((7, rows[2][1])) == 1 and sum(d is None and t in (a, rows[1][1]) for d, t in got) == 1


def test_awkward_rows(spark):
    got = [x.doc_id for x in r.one_of_each(frame(spark)).collect()]
    assert got.count(4) == 1 and 5 not in got and got.count(1) == 1 and not {2, 3} & set(got)
    assert r.one_of_each(frame(spark).limit(0)).count() == 0 and len(AWKWARD) == 10
