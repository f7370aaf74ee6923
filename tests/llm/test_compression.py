import collections

import zstandard
from helpers import LONG, documents, frame
from hypothesis import given
from hypothesis import strategies as st

from tickerloom.llm import op04_compression as c


def plain(text):
    w = text.encode().split()
    windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {j for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if any(ch not in c.BLANKS for ch in line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(ch not in c.BLANKS for ch in text), sum(ch in c.SYMBOLS for ch in text), dup, len(hit)


@given(st.text(alphabet=st.sampled_from("ab #\n\té *"), max_size=60))
def test_counts_match_plain(text):
    assert c.base_counts(text) == plain(text)


def test_whole_table(spark, sf):
    got = {r.doc_id: r for r in c.op4_compression_bands(spark, sf).collect()}
    docs = documents(sf)
    assert len(got) == len(docs)
    for d, t in zip(docs.doc_id, docs.text, strict=True):
        n, chars, symbols, dup, rep = plain(t)
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        failed = n < 50 or 100 * rep > 50 * n
        assert r.base_failed == failed and r.kept == (not failed and r.verdict == "ok")


def test_bands_reject_repetition_and_noise(spark):
    import random

    rnd = random.Random(0)
    noise = "".join(chr(rnd.randrange(0x4E00, 0x9FFF)) + " " * (i % 9 == 0) for i in range(4000))
    rows = [(1, LONG, "en", None), (2, noise, None, None), (3, "spam " * 100, None, None)]
    got = {r.doc_id: r.verdict for r in c.compression_quality(frame(spark, rows)).collect()}
    assert got[1] == got[3] == "repetitive" and got[2] == "incompressible"


def test_clean_documents_stay(spark, sf):
    import pandas as pd

    labels = pd.read_parquet(f"{sf}/labels.parquet")
    got = c.op4_compression_bands(spark, sf).toPandas().merge(labels, on="doc_id")
    good = got[(got.quality == 1) & ~got.base_failed]
    assert good.kept.all()


def test_awkward_rows(spark):
    rows = c.compression_quality(frame(spark)).collect()
    assert len(rows) == 10
    by = {r.doc_id: r for r in rows}
    assert by[1].verdict == by[2].verdict == "empty" and by[1].n_words == by[3].n_words == 0
    assert c.compression_quality(frame(spark).limit(0)).count() == 0


def test_ratios_and_bands_match_plain(spark, sf):
    def plain_verdict(text, b=c.Bands()):
        raw = text.encode()
        z = lambda x: len(x) / len(zstandard.ZstdCompressor(level=3).compress(x))
        if not raw:
            return "empty"
        for shorter, low, high in b.document:
            if len(raw) < shorter:
                break
        if not low <= z(raw) <= high:
            return "repetitive" if z(raw) > high else "incompressible"
        bad = 0
        for i in range(0, len(raw) if len(raw) > 2048 else 0, 2048):
            part = raw[i : i + 2048]
            shorter, low, high = next(x for x in b.chunk if len(part) < x[0])
            bad += len(part) * (not low <= z(part) <= high)
        return "chunks" if bad > len(raw) / 2 else "ok"

    docs = documents(sf)
    got = {r.doc_id: r.verdict for r in c.op4_compression_bands(spark, sf).collect()}
    assert got == {d: plain_verdict(t or "") for d, t in zip(docs.doc_id, docs.text, strict=True)}


def test_the_tail_is_judged():
    import random

    rnd, pack = random.Random(1), zstandard.ZstdCompressor(level=3)
    prose = " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma"]) + str(rnd.randrange(99)) for _ in range(400))[:2048].encode()
    sizes = [n for n, _ in c.chunk_ratios(prose + b"x" * 900, c.Bands(), pack)]
    assert sizes == [2048, 900] and c.judge(prose + b"x" * 900, c.Bands(), pack)[1] == 900 / 2948
    assert c.chunk_ratios(prose, c.Bands(), pack) == []
