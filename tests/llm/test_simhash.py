import numpy as np
import pandas as pd
import pytest
import xxhash
from helpers import documents, frame, words

from tickerloom.llm import graph
from tickerloom.llm import op06_simhash as h
from tickerloom.llm.graph import connected_components


def plain_fingerprint(text):
    w = words(text)
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if hs and 2 * sum(x >> b & 1 for x in hs) > len(hs))


def plain_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_matches_brute_force(spark, sf):
    docs = documents(sf)
    fp = {d: plain_fingerprint(t) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    want = plain_components(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    rows = h.op6_simhash_vp_forest(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.fingerprint, r.component_id) == (f"{fp[r.doc_id]:016x}", want[r.doc_id])


@pytest.mark.parametrize("blocks", [1, 2, 3, 5])
@pytest.mark.parametrize("leaf, cell", [(4, 1000), (1000, 8)])
def test_forest_loses_no_link(spark, blocks, leaf, cell):
    rng = np.random.default_rng(blocks)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(i) for i in rng.choice(64, k, replace=False)) for b in base[:30] for k in (1, 3, 4, 5)]
    fps = sorted({*map(int, base), *near})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    pairs = h.near_pairs(spark.createDataFrame([(x,) for x in signed], "fp long"), blocks=blocks, leaf=leaf, cell=cell)
    groups = {r.node: r.component for r in connected_components(pairs).collect()}
    want = plain_components(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    assert {x: groups.get(x, x) for x in signed} == want


def test_a_large_family_gives_few_edges():
    fps = np.array([1 << i | 1 << j for i in range(64) for j in range(i)], np.uint64)
    src, dst = h.local_links(fps, fps, 4)
    assert len(src) == len(fps) - 1 and len(set(dst.tolist())) == 1


def test_components_of_a_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, x) for x in range(1001, 1200)] + [(5, 5), (None, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(101)) and all(got[x] == 1000 for x in range(1000, 1200)) and len(got) == 301
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_stars_take_no_round(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graph, "_large_star", lambda df, salts, step=graph._large_star: rounds.append(1) or step(df, salts))
    components = lambda edges: {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert components([(3, 1), (1, 2), (2, 1), (9, 8)]) == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} and not rounds
    assert components([(1, 3), (2, 3)]) == {1: 1, 2: 1, 3: 1} and rounds  # a node with two lesser ones
    rounds.clear()
    assert components([(1, 2), (2, 3)]) == {1: 1, 2: 1, 3: 1} and rounds  # a chain


def test_awkward_rows(spark):
    rows = h.near_duplicates(frame(spark)).collect()
    assert len(rows) == 10
    by = {r.doc_id: r for r in rows}
    assert by[1].fp == by[2].fp == by[3].fp == 0 and by[3].component_id == 1
    assert by[5].component_id == 4
    assert h.near_duplicates(frame(spark).limit(0)).count() == 0


def test_long_text_is_counted_in_steps():
    text = " ".join(map(str, range(40_000)))
    assert h.simhash(h.shingle_hashes(text)) == plain_fingerprint(text)
    assert pd.Series(h.shingle_hashes("a b c")).tolist() == [xxhash.xxh64_intdigest(b"a b c", 42)]
