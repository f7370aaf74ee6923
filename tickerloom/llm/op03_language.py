"""Language ID by hierarchical discrimination.

First the language family is predicted, then one-versus-one linear support vector machines
separate the languages within it. Features are hashed byte trigrams of the lower-cased letters
of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import md5
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc_bucket, map_arrow, materialise, scratch, table

#: Families of ISO 639-1 codes; a language not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr"),
    "uralic": ("fi", "et", "hu"),
}
FAMILY_OF = {lang: name for name, langs in FAMILIES.items() for lang in langs}
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """``per_language`` different labelled texts at most are learned from, taken in hash order; of
    each also ``snippets`` short runs of its words, so that short texts are known too. With so
    many languages that this would be over ``most_texts``, each has its equal share of those, one
    text at least: no language is left out."""

    per_language: int = 300
    most_texts: int = 10_000
    snippets: int = 3
    snippet_words: tuple[int, ...] = (2, 5, 12)
    bits: int = 11
    penalty: float = 1e-4
    rounds: int = 300
    sharpness: float = 4.0


_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
_STEP = 1 << 20


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def trigram_features(text: str, bits: int) -> np.ndarray:
    """Square roots of hashed trigram counts, scaled to length 1 (zeros without a letter)."""
    raw = text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS)
    line = np.frombuffer(b" " + b" ".join(raw.split()) + b" ", np.uint8)
    counts = np.zeros(1 << bits, np.int64)
    for i in range(0, len(line) - 2, _STEP):
        a = line[i : i + _STEP + 2].astype(np.uint32)
        key = (a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]) * np.uint32(2654435761)
        counts += np.bincount(key >> np.uint32(32 - bits), minlength=1 << bits)
    out = np.sqrt(counts).astype(np.float32)
    norm = np.linalg.norm(out)
    return out / norm if norm else out


def snippets(text: str, s: Settings) -> list[str]:
    words = text.split()
    runs = [text]
    for k in range(s.snippets):
        n = s.snippet_words[k % len(s.snippet_words)]
        if len(words) > n:
            at = (len(words) - n) * (2 * k + 1) // (2 * s.snippets)
            runs.append(" ".join(words[at : at + n]))
    return [r for r in runs if has_letter(r)]


def fit_svm(x: np.ndarray, positive: np.ndarray, penalty: float, rounds: int) -> np.ndarray:
    """Weights and, last, bias of a linear machine: squared hinge loss, balanced classes, Nesterov steps."""
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    share = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    ahead, rate = w, 0.25  # rows have length 1 and a bias, so the curvature is 4 at most
    for t in range(rounds):
        push = share * y * np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1]))
        step = ahead - rate * (penalty * ahead - 2 * np.append(push @ x, push.sum()).astype(np.float32))
        ahead, w = step + t / (t + 3) * (step - w), step
    return w


@dataclass
class Machines:
    """One-versus-one machines over ``labels``; row k of ``weights`` separates ``pairs[k]``."""

    labels: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, s: Settings) -> Machines:
        labels = sorted(set(y.tolist()))
        pairs = list(combinations(range(len(labels)), 2))
        rows = []
        for a, b in pairs:
            use = (y == labels[a]) | (y == labels[b])
            own = x if use.all() else x[use]
            rows.append(fit_svm(own, y[use] == labels[a], s.penalty, s.rounds))
        return cls(labels, pairs, np.array(rows, np.float32) if rows else None)

    def predict(self, x: np.ndarray, sharpness: float) -> tuple[np.ndarray, np.ndarray]:
        """(index of the winner, its weakest duel as a number from 0 to 1)."""
        n = len(self.labels)
        if n == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        margin = x @ self.weights[:, :-1].T + self.weights[:, -1]
        win = 1 / (1 + np.exp(-sharpness * margin.astype(np.float64)))
        duel = np.full((len(x), n, n), np.nan)
        for k, (a, b) in enumerate(self.pairs):
            duel[:, a, b], duel[:, b, a] = win[:, k], 1 - win[:, k]
        votes = (duel > 0.5).sum(axis=2) + np.nanmean(duel, axis=2) / 2  # votes, then mean strength
        best = votes.argmax(axis=1)
        return best, np.nanmin(duel[np.arange(len(x)), best], axis=1)


@dataclass
class LanguageModel:
    settings: Settings
    families: Machines
    within: dict[str, Machines]

    @classmethod
    def fit(cls, x: np.ndarray, langs: np.ndarray, s: Settings) -> LanguageModel | None:
        if not len(langs):
            return None
        family = np.array([FAMILY_OF.get(lang, f"only {lang}") for lang in langs])
        within = {f: Machines.fit(x[family == f], langs[family == f], s) for f in sorted(set(family))}
        return cls(s, Machines.fit(x, family, s), within)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(languages, scores): a score is the weakest duel that the family and the language won."""
        k, sure = self.families.predict(x, self.settings.sharpness)
        langs = np.empty(len(x), object)
        for i, name in enumerate(self.families.labels):
            own = np.flatnonzero(k == i)
            if len(own):
                best, strength = self.within[name].predict(x[own], self.settings.sharpness)
                langs[own] = np.array(self.within[name].labels, object)[best]
                sure[own] = np.minimum(sure[own], strength)
        return langs, sure


def train(docs: DataFrame, label: str = "lang", s: Settings = Settings()) -> LanguageModel | None:
    """Fit on ``docs`` (text, ``label``); None if no row has a label and a letter.

    Texts are drawn by their hash, whatever their ids, and a text that is repeated counts once. Of
    each language different texts are counted (by a sketch), and only hashes under a threshold of
    four times the share that is needed are ordered, so no task orders a whole language; a
    language of few texts is taken whole. Then only the drawn texts are read, one copy of each,
    turned into features on the executors, and brought to the driver: at most ``most_texts`` (or
    one a language) times snippets + 1 rows of 2**bits half floats.
    """
    with scratch(docs.sparkSession):
        labelled = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull()).select(F.col(label).alias("lang"), F.xxhash64("text").alias("h"), "text")
        sizes = labelled.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"))
        sizes = materialise(sizes, "languages")
        each = min(s.per_language, max(1, s.most_texts // max(1, sizes.count())))
        share = sizes.select("lang", (F.lit(4.0 * each) / F.col("n")).alias("share"))
        place = F.pmod(F.xxhash64("h"), F.lit(1 << 32)) / float(1 << 32)  # even in [0, 1)
        under = labelled.select("lang", "h").join(share, "lang").where(place < F.col("share")).select("lang", "h").distinct()
        order = W.partitionBy("lang").orderBy(place, "h")
        drawn = materialise(under.withColumn("k", F.row_number().over(order)).where(F.col("k") <= each).select("lang", "h"), "drawn-texts")

        def rows(batch: pa.RecordBatch) -> dict[str, list]:
            langs, xs = [], []
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                for run in snippets(text.as_py(), s):
                    langs.append(lang.as_py())
                    xs.append(trigram_features(run, s.bits).astype(np.float16).tobytes())
            return {"lang": langs, "x": xs}

        chosen = labelled.join(drawn, ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("text").alias("text"))
        got = map_arrow(chosen.select("text", "lang"), "lang string, x binary", rows).toArrow()
    if not got.num_rows:
        return None
    langs = np.array(got.column("lang").to_pylist(), object)
    features = got.column("x").combine_chunks()
    del got
    # rows in an order of their own, so that the sums do not depend on how tasks ended
    order = sorted(range(len(langs)), key=lambda i: (langs[i], md5(features[i].as_buffer()).digest()))
    x = np.empty((len(langs), 1 << s.bits), np.float32)
    for k, i in enumerate(order):
        x[k] = np.frombuffer(features[i].as_buffer(), np.float16)
    del features
    pa.default_memory_pool().release_unused()
    return LanguageModel.fit(x, langs[order], s)


def _judge(texts: pa.ChunkedArray | pa.Array, m: LanguageModel | None) -> tuple[np.ndarray, np.ndarray]:
    texts = [t.as_py() or "" for t in texts]
    langs, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    own = [i for i, t in enumerate(texts) if m is not None and has_letter(t)]
    for i in range(0, len(own), 1024):
        part = own[i : i + 1024]
        langs[part], scores[part] = m.predict(np.array([trigram_features(texts[j], m.settings.bits) for j in part]))
    return langs, scores


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs`` (doc_id, text).

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned. Of languages
    with equally many votes the one with the greater mean strength wins, of equals the first by
    name. Repeated rows are judged one by one; an empty table gives no rows; other columns, lang
    and source among them, are never read. A very long text is judged whole. One pass without a shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batch: pa.RecordBatch) -> dict[str, list]:
        langs, scores = _judge(batch.column("text"), held.value)
        return {"doc_id": batch.column("doc_id"), "lang_pred": langs.tolist(), "score": scores}

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(source, "doc_id long, lang_pred string, score double", rows)


def with_known_language(docs: DataFrame, model: LanguageModel | None, least: float, lang: str = "lang") -> DataFrame:
    """Rows of ``docs`` whose language is predicted with a score of ``least`` or more, all columns
    kept and ``lang`` (added if absent) replaced by the prediction.

    Rows pass through the one judging pass itself, so nothing is joined or shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    if lang not in docs.columns:
        docs = docs.withColumn(lang, F.lit(None).cast("string"))
    place = docs.columns.index(lang)
    source = docs.withColumn(lang, F.col(lang).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = _judge(batch.column("text"), held.value)
            keep = pa.array((scores >= least) & (langs != UNKNOWN))
            yield batch.set_column(place, lang, pa.array(langs.tolist(), batch.schema.field(place).type)).filter(keep)

    return source.mapInArrow(run, source.schema)


FOLDS, HELD_OUT = 3, 1


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(crc_bucket("doc_id", FOLDS) != HELD_OUT).select("doc_id", "text", "lang")


def op3_hierarchical_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; held_out is false for a null doc_id."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(learnable(docs))).select(
        "doc_id", F.coalesce(crc_bucket("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
