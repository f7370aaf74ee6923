"""LM scoring by Katz backoff with Good-Turing discounts.

Bigrams back off to unigrams and these to one class for all unknown words. Seen n-grams are
discounted by Good-Turing; what that frees goes to the unseen ones, scaled so that each context
sums to exactly 1.

The corpus is worked in chunks of a few megabytes of text. A chunk never sends tokens: it asks
for the counts of its *distinct* words and word pairs, in sorted, packed blocks. Words are
grouped by hash, pairs by a grid over (context, word), so that a frequent word's pairs are spread
over a row or column of cells; each cell counts its pairs over all chunks and answers every chunk.
The counts, contexts and backoff weights are tables in the shared folder, partitioned by kind.
Nothing is capped, pruned or sampled: unigram, bigram and context tables grow with the corpus.
"""

from __future__ import annotations

import math
import struct
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, fresh_path, remove, table, tidy_shuffles

#: A word that no text can hold stands for the end of a text.
END = b"\n"
START_GID = 0  # the context before a text's first word; words have 1, 2, ...
UNKNOWN_GID = -1


@dataclass(frozen=True)
class Settings:
    """``chunk_bytes`` of text are worked at a time; counts over ``k`` are not discounted.

    Words fall into ``buckets`` and pairs into as many grid cells in ``columns`` columns. If 0,
    there is a bucket for every ``bucket_bytes`` of text, but no fewer than the session's shuffle
    partitions, so what one group holds does not grow with the corpus, and the grid is square, so
    a frequent context is spread wider the larger the corpus is."""

    chunk_bytes: int = 8 << 20
    k: int = 5
    bucket_bytes: int = 4 << 20
    columns: int = 0
    buckets: int = 0


# ---- packed blocks -----------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, so that high zero bytes compress away."""
    head, body = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        if a.dtype.kind in "iu" and len(a) and a.min() >= 0:
            a = a.astype(np.min_scalar_type(int(a.max())))
        head.append(struct.pack("<cBq", a.dtype.char.encode(), a.itemsize, len(a)))
        body.append(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if a.itemsize > 1 else a.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, heads, out = raw[0], 1, [], []
    for _ in range(n):
        heads.append(struct.unpack_from("<cBq", raw, at))
        at += struct.calcsize("<cBq")
    for char, size, length in heads:
        part = np.frombuffer(raw, np.uint8, size * length, at)
        at += size * length
        out.append(np.ascontiguousarray(part.reshape(size, length).T).view(np.dtype(char.decode())).ravel())
    return out


def wide(a: np.ndarray) -> np.ndarray:
    return a.astype(np.int64)


# ---- the model's numbers -------------------------------------------------------------------


def discounts(n: np.ndarray, k: int) -> np.ndarray:
    """d[r] for r = 1..k (index r - 1) from the numbers n[r - 1] of n-grams seen r times.

    Katz's formula; where it gives no number between 0 and 1 (too few counts), 1.
    """
    n = np.asarray(n, float)
    d = np.ones(k)
    if n[0] > 0:
        tail = (k + 1) * n[k] / n[0]
        for r in range(1, k + 1):
            if n[r - 1] > 0 and tail < 1:
                v = ((r + 1) * n[r] / n[r - 1] / r - tail) / (1 - tail)
                if 0 < v < 1:
                    d[r - 1] = v
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * np.append(d, 1.0)[np.minimum(c, len(d) + 1) - 1]


@dataclass
class Unigrams:
    """P(w) = d(c) c / total; all unknown words together have what is left of 1."""

    tokens: int
    words: int
    d: np.ndarray
    total: float = 0.0
    unknown: float = 1.0

    @classmethod
    def fit(cls, tokens: int, words: int, seen: np.ndarray, k: int) -> Unigrams:
        d = discounts(seen, k)
        mass = tokens - float(((1 - d) * np.arange(1, k + 1) * seen[:k]).sum())
        total = float(tokens)
        if mass >= tokens:  # nothing was freed: one token more, unknown
            total, mass = tokens + 1.0, float(tokens)
        return cls(tokens, words, d, total, 1 - mass / total)

    def p(self, c: np.ndarray) -> np.ndarray:
        out = np.full(len(c), self.unknown)
        seen = c > 0
        out[seen] = discounted(c[seen], self.d) / self.total
        return out


def backoff(total: np.ndarray, kept: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, divisor) of contexts: their count, the discounted count of their followers, and
    the followers' lower-order probability. A context that frees nothing counts one more."""
    divisor = np.where(kept >= total, total + 1.0, total)
    return (1 - kept / divisor) / (1 - lower), divisor


# ---- pass 1: chunks -------------------------------------------------------------------------

CHUNKS = "kind string, chunk long, bucket int, payload binary"


def _chunk_rows(chunk: int, docs: list[tuple], buckets: int) -> list[tuple]:
    vocabulary: dict[bytes, int] = defaultdict(count().__next__)
    end = vocabulary[END]
    parts, tail = [], np.array([end], np.int32)
    for _, text, _ in docs:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        parts += [np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)), tail]
    tokens = np.concatenate(parts)
    lengths = np.array([len(p) + 1 for p in parts[::2]], np.int64)
    ids = np.array([d if d is not None else 0 for d, _, _ in docs], np.int64)
    null = np.array([d is None for d, _, _ in docs], bool)
    train = np.array([t for _, _, t in docs], bool)
    counts = np.bincount(tokens[np.repeat(train, lengths)], minlength=len(vocabulary))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, vocabulary), np.uint64, len(vocabulary))
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((hashes, bucket))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    rows = [("docs", chunk, 0, pack(ids.view(np.uint64), null, train, lengths, rank[tokens]))]
    hashes, counts, bucket = hashes[order], counts[order], bucket[order]
    for b, lo, hi in _segments(bucket):
        rows.append(("words", chunk, b, pack(hashes[lo:hi], counts[lo:hi])))
    if bucket[0]:  # bucket 0 also answers for the start of a text, so it is always asked
        rows.append(("words", chunk, 0, pack(hashes[:0], counts[:0])))
    return rows


def _segments(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if len(sorted_keys):
        cuts = np.flatnonzero(np.diff(sorted_keys)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sorted_keys)], strict=True):
            yield int(sorted_keys[lo]), lo, hi


def chunk_encoder(buckets: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, docs, size = TaskContext.get().partitionId() << 32, 0, [], 0
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        types = [pa.string(), pa.int64(), pa.int32(), pa.binary()]

        def flush() -> pa.RecordBatch:
            rows = _chunk_rows(first + made, docs, buckets)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for doc, text, train in zip(*(batch.column(c) for c in ("doc_id", "text", "train")), strict=True):
                body = text.as_py() or ""
                docs.append((doc.as_py(), body, train.as_py()))
                size += len(body)
                if size >= chunk_bytes:
                    yield flush()
                    made, docs, size = made + 1, [], 0
        if docs:
            yield flush()

    return run


# ---- unigrams ------------------------------------------------------------------------------

ANSWERS = "kind string, chunk long, bucket int, payload binary"


def count_words(buckets: int, k: int):
    """Per bucket: global ids (frequent words first) and counts, for the table and each chunk."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(key[0])
        parts = [unpack(p) for p in pdf["payload"]]
        hashes, back = np.unique(np.concatenate([p[0] for p in parts]).astype(np.uint64), return_inverse=True)
        total = np.bincount(back, np.concatenate([wide(p[1]) for p in parts])).astype(np.int64)
        order = np.argsort(-total, kind="stable")
        gid = np.empty(len(total), np.int64)
        gid[order] = 1 + b + buckets * np.arange(len(total))
        gid[total == 0] = UNKNOWN_GID
        rows, at = [], 0
        for chunk, p in zip(pdf["chunk"], parts, strict=True):
            own = back[at : at + len(p[0])]
            at += len(p[0])
            rows.append(("words", chunk, b, pack(gid[own] + 1, total[own])))
        seen = total > 0
        rows.append(("unigram", -1, b, pack(hashes[seen], gid[seen], total[seen])))
        rows.append(("stat", -1, b, pack(_count_of_counts(total, k))))
        return pd.DataFrame(rows, columns=["kind", "chunk", "bucket", "payload"])

    return run


def _count_of_counts(c: np.ndarray, k: int) -> np.ndarray:
    """[sum, distinct, seen once, ..., seen k + 1 times] of positive counts."""
    c = c[c > 0]
    return np.array([c.sum(), len(c), *np.bincount(np.minimum(c, k + 2), minlength=k + 3)[1 : k + 2]], np.int64)


def read_stats(df: DataFrame, k: int) -> np.ndarray:
    """The summed statistics: one small row for each bucket or cell comes to the driver."""
    total = np.zeros(k + 3, np.int64)
    for row in df.where("kind = 'stat'").select("payload").toLocalIterator():
        total += wide(unpack(row["payload"])[0])
    return total


# ---- pairs ---------------------------------------------------------------------------------


@dataclass
class ChunkPairs:
    """A chunk's tokens with global ids, and its distinct pairs of known words by grid cell."""

    ids: np.ndarray
    null: np.ndarray
    train: np.ndarray
    lengths: np.ndarray
    tokens: np.ndarray  # local word of each token
    before: np.ndarray  # local word before it, or the number of words at a text's start
    counts: np.ndarray  # training count by local word
    known: np.ndarray  # tokens whose pair was asked for
    pair: np.ndarray  # of those, the place among the distinct pairs, as sorted
    cell: np.ndarray
    v: np.ndarray
    w: np.ndarray
    word: np.ndarray  # local word w of each distinct pair
    times: np.ndarray  # training count within the chunk

    @classmethod
    def of(cls, docs: bytes, words: pd.DataFrame, buckets: int, columns: int, count_pairs: bool) -> ChunkPairs:
        ids, null, train, lengths, tokens = unpack(docs)
        lengths, tokens = wide(lengths), wide(tokens)
        answers = [unpack(p) for p in words.sort_values("bucket")["payload"]]
        gid = np.concatenate([wide(a[0]) for a in answers]) - 1
        counts = np.concatenate([wide(a[1]) for a in answers])
        n = len(gid)
        before = np.concatenate(([n], tokens[:-1]))
        before[np.cumsum(lengths)[:-1]] = n
        context = np.append(gid, START_GID)
        known = np.flatnonzero((gid[tokens] > 0) & (context[before] >= 0))
        keys, pair = np.unique(before[known] * (n + 1) + tokens[known], return_inverse=True)
        v, word = context[keys // (n + 1)], keys % (n + 1)
        w = gid[word]
        rows = max(1, buckets // columns)
        # the start of a text is a context of all texts, so its pairs are spread over the whole grid
        row = np.where(v == START_GID, w * 69069 // 64, bucket_of(v, buckets)) % rows
        cell = row * columns + w * 40503 // 8 % columns
        order = _lexsort(cell, v, w)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        times = np.zeros(0, np.int64)
        if count_pairs:
            learned = np.repeat(train.astype(bool), lengths)[known]
            times = np.bincount(pair[learned], minlength=len(keys))[order]
        return cls(
            ids.view(np.int64) if ids.itemsize == 8 else wide(ids), null.astype(bool), train.astype(bool), lengths, tokens, before, counts,
            known, place[pair], cell[order], v[order], w[order], word[order], times,
        )


def _lexsort(*keys: np.ndarray) -> np.ndarray:
    """Stable order by the first key, then the next, in one sort where they fit 62 bits."""
    bits = [int(k.max()).bit_length() if len(k) else 0 for k in keys]
    if sum(bits) > 62:
        return np.lexsort(keys[::-1])
    packed = np.zeros(len(keys[0]), np.int64)
    for k, b in zip(keys, bits, strict=True):
        packed = packed << b | k
    return np.argsort(packed, kind="stable")


def bucket_of(gid: np.ndarray, buckets: int) -> np.ndarray:
    return np.where(gid > 0, (gid - 1) % buckets, 0)


def ask_pairs(buckets: int, columns: int):
    def run(docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for chunk, payload in zip(docs["chunk"], docs["payload"], strict=True):
            p = ChunkPairs.of(payload, words, buckets, columns, True)
            for cell, lo, hi in _segments(p.cell):
                own = slice(lo, hi)
                rows.append((cell, chunk, pack(p.v[own], p.w[own], p.times[own], p.counts[p.word[own]])))
        return pd.DataFrame(rows, columns=["cell", "chunk", "payload"])

    return run


def count_pairs(buckets: int, k: int, unigrams: Unigrams):
    """Per cell: pair counts over all chunks, answers, and what each context's followers add up to."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cell = int(key[0])
        sizes, columns = [], [[], [], [], []]
        for payload in pdf["payload"]:
            for col, a in zip(columns, unpack(payload), strict=True):
                col.append(a)
            sizes.append(len(columns[0][-1]))
        v, w, times, single = (wide(np.concatenate(c)) for c in columns)
        order = _lexsort(v, w)
        v, w = v[order], w[order]
        new = np.concatenate(([True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])))
        place = np.cumsum(new) - 1
        total = np.bincount(place, times[order]).astype(np.int64)
        answer = np.empty(len(order), np.int64)
        answer[order] = total[place]
        rows, at = [], 0
        for chunk, n in zip(pdf["chunk"], sizes, strict=True):
            rows.append(("pairs", chunk, cell, pack(answer[at : at + n])))
            at += n
        v, w, single = v[new], w[new], single[order][new]
        seen = total > 0
        v, w, c, single = v[seen], w[seen], total[seen], single[seen]
        rows.append(("stat", -1, cell, pack(_count_of_counts(c, k))))
        if len(v):
            rows.append(("bigram", -1, cell, pack(v, w, c)))
            starts = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
            context = v[starts]
            by_count = [np.add.reduceat((c == r).astype(np.int64), starts) for r in range(1, k + 1)]
            big = np.add.reduceat(np.where(c > k, c, 0), starts)
            lower = np.add.reduceat(unigrams.p(single), starts)
            bucket = bucket_of(context, buckets)
            by = np.argsort(bucket, kind="stable")
            for b, lo, hi in _segments(bucket[by]):
                own = by[lo:hi]
                rows.append(("context", cell, b, pack(context[own], *[m[own] for m in by_count], big[own], lower[own])))
        return pd.DataFrame(rows, columns=["kind", "chunk", "bucket", "payload"])

    return run


# ---- contexts and scores -------------------------------------------------------------------


def weigh_contexts(buckets: int, d: np.ndarray):
    """Per bucket of contexts: backoff weights, for the table and for each chunk's words."""
    k = len(d)

    def run(key: tuple, contexts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        rows, b = [], int(key[0])
        parts = [unpack(p) for p in contexts["payload"]]
        if parts:
            v, back = np.unique(np.concatenate([wide(p[0]) for p in parts]), return_inverse=True)
            add = lambda i: np.bincount(back, np.concatenate([p[i] for p in parts]), len(v))
            by_count, big, lower = [add(1 + r) for r in range(k)], add(k + 1), add(k + 2)
            total = big + sum((r + 1) * m for r, m in enumerate(by_count))
            kept = big + sum(d[r] * (r + 1) * m for r, m in enumerate(by_count))
            alpha, divisor = backoff(total, kept, lower)
            rows.append(("backoff", -1, b, pack(v, total.astype(np.int64), alpha, divisor.astype(np.int64))))
        else:
            v, alpha, divisor = np.empty(0, np.int64), np.empty(0), np.empty(0)
        for chunk, payload in zip(words["chunk"], words["payload"], strict=True):
            ask = wide(unpack(payload)[0]) - 1
            if b == 0:
                ask = np.append(ask, START_GID)  # every chunk's last question to bucket 0
            at = np.searchsorted(v, ask)
            hit = at < len(v)
            hit[hit] = v[at[hit]] == ask[hit]
            a, div = np.ones(len(ask)), np.zeros(len(ask), np.int64)
            a[hit], div[hit] = alpha[at[hit]], divisor[at[hit]]
            rows.append(("alpha", chunk, b, pack(a, div)))
        return pd.DataFrame(rows, columns=["kind", "chunk", "bucket", "payload"])

    return run


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score_chunks(buckets: int, columns: int, unigrams: Unigrams, d: np.ndarray):
    """Per chunk: the recursion of every token of every text."""

    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, payload in zip(docs["chunk"], docs["payload"], strict=True):
            of = {k: g.sort_values("bucket") for k, g in answers.groupby("kind")}
            p = ChunkPairs.of(payload, of["words"], buckets, columns, False)
            c = p.counts[p.tokens]
            base = np.log10((c + 1) / (unigrams.tokens + unigrams.words + 1))
            alpha, divisor = np.empty(len(p.counts) + 1), np.zeros(len(p.counts) + 1, np.int64)
            at = 0
            alpha[-1], divisor[-1] = 1.0, 0
            for b, data in zip(of["alpha"]["bucket"], of["alpha"]["payload"], strict=True):
                a, div = unpack(data)
                if b == 0:
                    alpha[-1], divisor[-1] = a[-1], div[-1]
                    a, div = a[:-1], div[:-1]
                alpha[at : at + len(a)], divisor[at : at + len(a)] = a, div
                at += len(a)
            # unigram level, then one step up for every token with a known context
            lower = np.log10(unigrams.p(p.counts))[p.tokens]
            score = lower + np.log10(alpha)[p.before]
            if "pairs" in of:
                got = np.concatenate([wide(unpack(x)[0]) for x in of["pairs"]["payload"]])[p.pair]
                seen = p.known[got > 0]
                score[seen] = np.log10(discounted(got[got > 0], d) / divisor[p.before[seen]])
            starts = np.cumsum(p.lengths) - p.lengths
            add = lambda x: np.add.reduceat(x, starts)
            ids = pd.array(p.ids, dtype="Int64")
            ids[p.null] = pd.NA
            out.append(pd.DataFrame({"doc_id": ids, "n_tokens": p.lengths, "n_known": add((c > 0).astype(np.int64)), "base_score": add(base), "score": add(score)}))
        return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in SCORES.split(", ")])

    return run


# ---- the operator ----------------------------------------------------------------------------


#: Folder, kind, columns and payload places of the tables that ``KatzModel.rows`` reads.
TABLES = {
    "unigram": ("words", "hash long, word long, count long", (0, 1, 2)),
    "bigram": ("pairs", "context long, word long, count long", (0, 1, 2)),
    "backoff": ("contexts", "context long, count long, alpha double, divisor long", (0, 1, 2, 3)),
}


@dataclass
class KatzModel:
    """Where the tables are, and the numbers that the driver knows.

    The tables lie packed under ``path``/words, /pairs and /contexts, partitioned by kind and with
    a row for each bucket of words or contexts or cell of pairs; ``rows`` gives them as plain rows.
    """

    path: str
    unigrams: Unigrams
    bigram_discounts: np.ndarray

    def rows(self, spark: SparkSession, kind: str) -> DataFrame:
        """``unigram`` (hash, word, count, discounted), ``bigram`` (context, word, count,
        discounted) or ``backoff`` (context, count, alpha, divisor).

        A word's ``hash`` is the XXH64 of its bytes as a signed long; context 0 is the start of a text.
        """
        folder, ddl, places = TABLES[kind]
        d = {"unigram": self.unigrams.d, "bigram": self.bigram_discounts}.get(kind)
        names = [c.split()[0] for c in ddl.split(", ")] + ["discounted"] * (d is not None)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for payload in batch.column("payload"):
                    own = unpack(payload.as_py())
                    cols = [own[i] if own[i].dtype.kind == "f" else own[i].astype(np.uint64).view(np.int64) for i in places]
                    if d is not None:
                        cols.append(discounted(cols[2], d))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

        packed = spark.read.schema(ANSWERS).parquet(f"{self.path}/{folder}").where(F.col("kind") == kind).select("payload")
        return packed.mapInArrow(run, ddl + ", discounted double" * (d is not None))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.partitionBy("kind").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def score_texts(docs: DataFrame, train: str, s: Settings = Settings(), path: str | None = None) -> tuple[DataFrame, KatzModel]:
    """Learn from the rows of ``docs`` (doc_id, text, ``train`` boolean) where ``train`` is true,
    and score all rows: (doc_id, n_tokens, n_known, base_score, score), scores in log10.

    A null or empty text is its end alone. Repeated rows are learned and scored each. With
    nothing to learn from, every word is the unknown class, with probability 1. A very long text
    is a chunk of its own; an empty table gives no rows; other columns play no part, whatever their
    names. Words are known by a 64-bit hash.
    """
    spark = docs.sparkSession
    with tidy_shuffles(spark):  # each step's result is a table
        source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(train).alias("train"))
        size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = s.buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // s.bucket_bytes))
        columns = s.columns or max(4, math.isqrt(buckets))
        buckets = max(columns, buckets // columns * columns)
        by = lambda df, key: df.repartition(buckets, key).groupBy(key)  # noqa: E731  tasks follow the corpus too
        path = path or fresh_path(spark, "katz")
        chunks = _written(source.mapInArrow(chunk_encoder(buckets, s.chunk_bytes), CHUNKS), f"{path}/chunks")
        words = _written(
            by(chunks.where("kind = 'words'"), "bucket").applyInPandas(count_words(buckets, s.k), ANSWERS), f"{path}/words"
        )
        remove(spark, f"{path}/chunks/kind=words")
        tokens, distinct, *seen = read_stats(words, s.k).tolist()
        unigrams = Unigrams.fit(tokens, distinct, np.array(seen), s.k)
        texts = chunks.where("kind = 'docs'").select("chunk", "payload")
        asked = words.where("kind = 'words'").select("chunk", "bucket", "payload")
        questions = (
            by(texts, "chunk").cogroup(by(asked, "chunk")).applyInPandas(ask_pairs(buckets, columns), "cell int, chunk long, payload binary")
        )
        pairs = _written(by(questions, "cell").applyInPandas(count_pairs(buckets, s.k, unigrams), ANSWERS), f"{path}/pairs")
        d = discounts(read_stats(pairs, s.k)[2:], s.k)
        contexts = pairs.where("kind = 'context'").select("bucket", "payload")
        weights = _written(
            by(contexts, "bucket").cogroup(by(asked, "bucket")).applyInPandas(weigh_contexts(buckets, d), ANSWERS), f"{path}/contexts"
        )
        remove(spark, f"{path}/pairs/kind=context")
        answers = (
            words.where("kind = 'words'")
            .unionByName(pairs.where("kind = 'pairs'"))
            .unionByName(weights.where("kind = 'alpha'"))
        )
        scored = by(texts, "chunk").cogroup(by(answers, "chunk")).applyInPandas(
            score_chunks(buckets, columns, unigrams, d), SCORES
        )
        return scored, KatzModel(path, unigrams, d)


FOLDS, HELD_OUT = 7, 2


def op1_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those outside the held-out fold (a null doc_id is in
    none, so it is learned from)."""
    held_out = F.coalesce(crc_bucket("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (~held_out).alias("train"))
    scored, model = score_texts(docs, "train")
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known",
        F.lit(model.unigrams.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
