import collections
import math
import zlib

import numpy as np
from helpers import documents, frame
from pyspark.sql import functions as F

from tickerloom.llm import op03_language as lang


def test_held_out_accuracy(spark, sf):
    got = lang.op3_hierarchical_svm(spark, sf).toPandas().merge(documents(sf), on="doc_id")
    assert len(got) == len(documents(sf))
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got.doc_id]).all()
    known = got[got.held_out & got.lang.notna() & got.text.fillna("").str.contains(r"[^\W\d_]{3}")]
    assert (known.lang_pred == known.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_awkward_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = lang.train(lang.learnable(docs))
    rows = lang.identify(frame(spark), model).collect()
    assert len(rows) == 10
    by = {r.doc_id: r for r in rows}
    assert {by[i].lang_pred for i in (1, 2, 3, 7)} == {"und"} and by[1].score == 0
    assert by[6].lang_pred != "und"
    assert {r.lang_pred for r in lang.identify(frame(spark), None).collect()} == {"und"}
    assert lang.identify(frame(spark).limit(0), model).count() == 0


def test_no_labels_and_one_label(spark):
    docs = frame(spark, [(1, "abc def", None, None), (2, "ghi", None, None)], extra=False)
    assert lang.train(docs) is None
    one = lang.train(frame(spark, [(1, "abc def", "en", None), (2, "ghi", "en", None)], extra=False))
    assert {(r.lang_pred, r.score) for r in lang.identify(docs, one).collect()} == {("en", 1.0)}


def test_unlisted_languages_are_families_of_their_own():
    x = np.eye(6, dtype=np.float32)
    m = lang.LanguageModel.fit(x, np.array(["en", "en", "de", "xx", "xx", "fr"], object), lang.Settings(bits=3))
    assert m.families.labels == ["germanic", "only xx", "romance"]
    assert m.predict(x)[0].tolist() == ["en", "en", "de", "xx", "xx", "fr"]


def test_machines_match_plain_duels():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 8)).astype(np.float32)
    labels = ["a", "b", "c", "d"]
    m = lang.Machines.fit(x, np.array([labels[i % 4] for i in range(40)], object), lang.Settings(bits=3, rounds=20))
    best, sure = m.predict(x, 4.0)
    for row, k, s in zip(x.astype(float), best, sure, strict=True):
        won = {}
        for (a, b), w in zip(m.pairs, m.weights.astype(float), strict=True):
            p = 1 / (1 + math.exp(-4 * (row @ w[:-1] + w[-1])))
            won[a, b], won[b, a] = p, 1 - p
        duels = [[won[a, b] for b in range(4) if b != a] for a in range(4)]
        place = lambda a: (sum(p > 0.5 for p in duels[a]) + sum(duels[a]) / 3 / 2, -a)
        assert k == max(range(4), key=place) and math.isclose(s, min(duels[k]), rel_tol=1e-4)


def rows_learned(monkeypatch):
    seen = []
    fit = lang.LanguageModel.fit
    monkeypatch.setattr(lang.LanguageModel, "fit", staticmethod(lambda x, langs, s: seen.append(collections.Counter(langs.tolist())) or fit(x, langs, s)))
    return seen


def test_repeated_ids_and_texts_lose_no_language_and_keep_the_bound(spark, monkeypatch):
    seen = rows_learned(monkeypatch)
    few = lang.Settings(per_language=30, snippets=0, rounds=5)
    english = [(7, f"plain words of number {i} here", "en", None) for i in range(3000)]
    copies = [(i, "one text many times", "fr", None) for i in range(2000)] + [(i, "another text of french", "fr", None) for i in range(3)]
    german = [(9, f"worte und zahl {i}", "de", None) for i in range(40)] + [(None, f"ohne kennung {i}", "de", None) for i in range(40)]
    docs = frame(spark, english + copies + german, extra=False)
    lang.train(docs, s=few)
    assert seen[0] == {"en": 30, "fr": 2, "de": 30}
    lang.train(docs.repartition(5), s=few)
    lang.train(docs, s=lang.Settings(per_language=30, most_texts=12, snippets=0, rounds=5))
    assert seen[1] == seen[0] and seen[2] == {"en": 4, "fr": 2, "de": 4}


def test_the_draw_is_the_first_by_hash(spark, monkeypatch):
    seen = []
    fit = lang.LanguageModel.fit
    monkeypatch.setattr(lang.LanguageModel, "fit", staticmethod(lambda x, langs, s: seen.append(x) or fit(x, langs, s)))
    texts = [f"text of number {i} and {chr(97 + i % 26)}" for i in range(400)]
    docs = frame(spark, [(i, t, "en", None) for i, t in enumerate(texts)], extra=False)
    s = lang.Settings(per_language=20, snippets=0, rounds=5)
    lang.train(docs, s=s)
    hashed = docs.select("text", F.pmod(F.xxhash64(F.xxhash64("text")), F.lit(1 << 32)).alias("o")).orderBy("o").limit(20).collect()
    want = sorted(lang.trigram_features(r.text, s.bits).astype(np.float16).tobytes() for r in hashed)
    assert sorted(row.astype(np.float16).tobytes() for row in seen[0]) == want
