import re
from itertools import combinations

import pandas as pd
import pytest
from helpers import AWKWARD, documents, frame
from test_decontamination import plain as plain_leaks
from test_resemblance import plain_heads
from test_secrets import plain as plain_secrets

import corpus_pipeline as cp
from tickerloom.llm.common import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def staged(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in cp.STAGES:
        docs = materialise(stage(spark, docs, sf), name.replace(" ", "-"))
        out.append(docs)
    return out


def test_stages_are_named_in_order():
    assert [n for n, _ in cp.STAGES] == ["language ID", "SimHash near-dedup", "benchmark decontamination", "secret scans", "best-fit packing"]


def test_columns_stay(staged):
    assert all(df.columns == COLUMNS for df in staged[:-1])


def test_language_keeps_what_is_clear(staged, sf):
    docs, kept = documents(sf), staged[0].toPandas()
    clear = docs[docs.text.fillna("").map(lambda t: len(re.findall(r"[^\W\d_]{2,}", t)) >= 20)]
    assert set(clear.doc_id) <= set(kept.doc_id) and kept.doc_id.is_unique
    truth = kept.merge(docs, on="doc_id")
    assert (truth.lang_x == truth.lang_y).mean() > 0.97


def test_one_of_each_near_group_stays(staged):
    before, after = staged[0].toPandas(), staged[1].toPandas()
    assert set(after.doc_id) == plain_heads(list(zip(before.doc_id, before.text, strict=True))) and after.doc_id.is_unique


def test_near_dedup_chooses_by_content(spark, sf):
    """Rows of one id and text with other columns, and whole repeats: the same one stays every time."""
    text = "one row of a text with more than five words"
    rows = [(1, text, lang, source) for lang in ("en", "de", None) for source in ("a", "b")] * 2 + [(2, text, "en", "a")]
    picked = {tuple(cp.near_dedup(spark, frame(spark, own, False).repartition(3), sf).collect()) for own in (rows, rows[::-1])}
    assert len(picked) == 1 and len(next(iter(picked))) == 1


def test_leaks_without_id_go(spark, sf):
    item = pd.read_parquet(f"{sf}/benchmark.parquet").text[0]
    rows = [(None, f"before it {item} and after", "en", "s"), (None, "clean text under no id", "en", "s"), (3, f"again {item}", None, None), (3, "clean text under an id", None, None), (4, None, None, None)]
    assert sorted(str(r.text) for r in cp.decontaminate(spark, frame(spark, rows), sf).collect()) == ["None", "clean text under an id", "clean text under no id"]


def test_leaks_go_and_nothing_else(staged, sf):
    before, after = staged[1].toPandas(), staged[2].toPandas()
    leaks = {d for d, _ in plain_leaks(before, pd.read_parquet(f"{sf}/benchmark.parquet"))}
    assert set(before.doc_id) - set(after.doc_id) == leaks


def test_secrets_are_masked(staged):
    before, after = staged[2].toPandas().set_index("doc_id"), staged[3].toPandas().set_index("doc_id")
    assert sorted(before.index) == sorted(after.index)
    for d in before.index:
        if not plain_secrets(before.text[d]) and before.text[d] == after.text[d]:
            continue
        assert cp.MASK in after.text[d] and not plain_secrets(after.text[d])
        assert after.n_chars[d] == len(after.text[d])


def test_masking_keeps_the_rest(spark, sf):
    rows = [(1, "é key token=abcdefgh and AKIA" + "B" * 20 + " end", "en", None), (2, "password=" + "a1" * 12 + "!", None, None), (3, "clean", None, None)]
    got = {r.doc_id: r.text for r in cp.mask_secrets(spark, frame(spark, rows), sf).collect()}
    assert got == {1: "é key [secret] and [secret] end", 2: "[secret]!", 3: "clean"}


def test_every_kept_document_is_packed(staged):
    packed = staged[4].toPandas()
    assert set(packed.doc_id) == set(staged[3].toPandas().doc_id)
    for _, own in packed.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own.offset == own.length.cumsum() - own.length).all() and own.length.sum() <= 2048


def test_run_gives_the_last_stage(spark, sf, staged):
    assert cp.ORACLE_SQL is None
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, cp.run(spark, sf).select(*key).collect())) == sorted(map(tuple, staged[4].select(*key).collect()))


def test_stages_take_awkward_rows(spark, sf):
    for (_, stage), extra in zip(cp.STAGES, (True,) * 5, strict=True):
        df = frame(spark, AWKWARD, extra)
        out = stage(spark, df, sf)
        assert stage is cp.packed or out.columns == df.columns
        # the language stage learns from the rows themselves, and may find nothing to learn
        assert out.count() > 0 or stage is cp.language
        assert stage(spark, df.limit(0), sf).count() == 0
    kept = [r.doc_id for r in cp.near_dedup(spark, frame(spark), sf).collect()]
    assert kept.count(4) == 1 and 5 not in kept and all(a != b for a, b in combinations(kept, 2))
