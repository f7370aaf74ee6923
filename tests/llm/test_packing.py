import zlib

import numpy as np
import pytest
from helpers import documents, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from tickerloom.llm import op09_packing as p


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encode():
    e = p.Encoder(open(p.default_ranks(), "rb").read(), kept=50)
    return lambda text: np.frombuffer(e.encode(text), "<u4").tolist()


ODD = ["", " ", "  a  b ", "a\n b", "x <|endoftext|> y", "don't I'LL 123  456\t\n", "\x1c a\x1d", "日本語 テキスト", "a ", " a", "x\x85 y", "a　 b", "<|endoftext|>"]


@pytest.mark.parametrize("text", ODD)
def test_ids_are_the_tokenizer_librarys(text, encode, reference):
    assert encode(text) == reference(text)


@settings(max_examples=300)
@given(st.text(alphabet=st.sampled_from("  ab.1\n\té'sA　\xa0\x1f<日"), max_size=20))
def test_ids_of_random_texts(encode, reference, text):
    assert encode(text) == reference(text)


def test_cut_gives_the_first_piece_the_rest():
    assert p.cut(5, 4) == [(0, 1), (1, 4)] and p.cut(4, 4) == [(0, 4)] and p.cut(8, 4) == [(0, 4), (4, 4)] and p.cut(1, 4) == [(0, 1)]


@settings(max_examples=60)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=12))
def test_plan_is_best_fit_decreasing(counts):
    runs = p.plan(counts, 40)
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [i for i, r in enumerate(rooms) if r >= length]
            if fit:
                rooms[min(fit, key=lambda i: rooms[i])] -= length
            else:
                rooms.append(40 - length)
    places, given_ranks = {}, dict.fromkeys(counts, 0)
    for length, rank, n, first, each, offset in runs.tolist():
        assert rank == given_ranks[length]
        given_ranks[length] += n
        for k in range(n):
            places.setdefault(first + k // each, []).append((offset + k % each * length, length))
    assert given_ranks == counts and len(places) == len(rooms)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 40


def check(rows, texts, reference, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for d, own in by_doc.items():
        ids = np.array([*reference(texts[d] or ""), 0], "<u4")
        want = p.cut(len(ids), capacity)
        assert [(r.piece, r.start, r.length) for r in sorted(own, key=lambda r: r.piece)] == [(i, *w) for i, w in enumerate(want)]
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity


def test_whole_table(spark, sf, reference):
    docs = documents(sf)
    rows = p.op9_histogram_best_fit(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(docs.doc_id)
    check(rows, dict(zip(docs.doc_id, docs.text, strict=True)), reference, 2048)
    full = sum(r.length for r in rows) / 2048
    assert len({r.sequence_id for r in rows}) <= full * 1.02 + 2


def test_sequences_hold_the_ids(spark, sf, reference):
    rows = p.packed_sequences(spark.read.parquet(f"{sf}/documents.parquet").limit(40), 256).collect()
    assert all(r.n_tokens == len(r.ids) // 4 <= 256 for r in rows)


def test_awkward_rows(spark, reference):
    from tickerloom.llm.common import materialise

    rows = p.pack(materialise(p.pieces(frame(spark), 64), "pieces"), 64).collect()
    one = [r for r in rows if r.doc_id in (1, 2)]
    assert [(r.length, r.start) for r in one] == [(1, 0)] * 2
    assert sum(r.doc_id == 5 for r in rows) == 2 and sum(r.doc_id is None for r in rows) >= 1
    spans = {(r.sequence_id, r.offset) for r in rows}
    assert len(spans) == len(rows)
    assert p.pack(materialise(p.pieces(frame(spark).limit(0)), "pieces")).count() == 0


def test_equal_rows_are_ranked_in_slices(spark):
    from pyspark.sql import functions as F

    rows = spark.range(500).select(F.lit(1).alias("doc_id"), F.lit(0).alias("piece"), F.lit(9).alias("length"), F.lit(5).alias("ids_crc32"))
    rows = rows.unionByName(rows.limit(7).withColumn("length", F.lit(3)))
    got = p.with_rank(rows, "length", ["doc_id", "piece", "ids_crc32"], {9: 500, 3: 7}, most=40)
    assert got.columns == [*rows.columns, "rank"]
    for n, count in ((9, 500), (3, 7)):
        assert sorted(r["rank"] for r in got.where(F.col("length") == n).collect()) == list(range(count))
