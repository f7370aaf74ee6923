"""Best-fit packing planned on a length histogram.

Pieces are counted by length. Best-fit decreasing then runs over those counts, at most
``capacity`` of them, and gives runs of slots for each length; a piece takes the slot that its
rank among the pieces of its length names. No document takes part in the plan itself.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, table

CAPACITY, END_ID = 2048, 0
#: Fixed value: the vocabulary's one special token.
SPECIAL = {"<|endoftext|>": 50256}


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The vocabulary is byte_bpe_50k, in the form of ranks; the ids are those that the tokenizers
    library gives for the same vocabulary (see tests). Its splitting pattern never joins a blank
    to what stands before it, so a text may be cut before each blank that follows a non-blank,
    and the ids of words seen lately are kept (``kept`` of them at most).
    """

    def __init__(self, ranks: bytes, kept: int = 200_000):
        import public_tokenizers
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self._bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=SPECIAL)
        self._blanks = regex.compile(r"[\s\x1c-\x1f] ")
        self._seen: dict[str, bytes] = {}
        self._kept = kept

    def _whole(self, text: str) -> bytes:
        if any(s in text for s in SPECIAL):
            ids = self._bpe.encode(text, allowed_special="all")
        else:
            ids = self._bpe.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        got = self._seen[word] = np.array(self._bpe.encode_ordinary(" " + word), "<u4").tobytes()
        return got

    def encode(self, text: str) -> bytes:
        if any(s in text for s in SPECIAL) or self._blanks.search(text):
            return self._whole(text)
        first, *rest = text.split(" ")
        if len(self._seen) > self._kept:
            self._seen.clear()
        seen, word = self._seen, self._word
        return b"".join([self._whole(first) if first else b"", *[seen.get(w) or word(w) for w in rest]])


@lru_cache(maxsize=2)
def _encoder(ranks: bytes) -> Encoder:
    return Encoder(ranks)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; the first takes what is over."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of every row of ``docs`` (doc_id, text): ids of the text, then the end id.

    A null text is an empty one: a piece of the end id alone. An empty table gives no rows; other
    columns play no part, whatever their names. The vocabulary file (1 MB) is read on the driver
    and broadcast. ``with_ids`` adds the ids as bytes. Rows go out in blocks, so a
    very long text's ids are the most that a task holds.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(open(ranks_path or default_ranks(), "rb").read())
    names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks.value).encode
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py() or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    for col, x in zip(out, (doc, k, start, length, zlib.crc32(part), part), strict=False):
                        col.append(x)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=False)], names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, PIECES + ", ids binary" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over a histogram of lengths.

    Rows (length, first rank, ranks, first sequence, pieces a sequence, offset): the k-th rank
    of a run goes to sequence ``first + k // each`` at ``offset + k % each * length``. Sequences
    with the same room left are kept as ranges, so the work follows the number of lengths.
    """
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("a length is not between 1 and the capacity")
    rooms: list[int] = []
    ranges: dict[int, list[tuple[int, int]]] = {}
    runs, made = [], 0

    def keep(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in ranges:
                insort(rooms, room)
                ranges[room] = []
            ranges[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room], rooms[at]
            else:
                room, first, n = capacity, made, -(-left // (capacity // length))
                made += n
            each = min(room // length, left)
            full = min(n, left // each)
            runs.append((length, rank, full * each, first, each, capacity - room))
            keep(room - each * length, first, full)
            keep(room, first + full, n - full)
            rank, left = rank + full * each, left - full * each
    return np.array(runs, np.int64).reshape(-1, 6)


def with_rank(df: DataFrame, group: str, order: list[str], counts: dict[int, int], most: int = 1 << 20) -> DataFrame:
    """Add ``rank`` 0, 1, ... within each ``group``; ``counts`` says how many rows each group has.

    A group is ordered in slices of about ``most`` rows, however large it is, and rows that are
    equal in all of ``order`` are spread over its slices too. ``group`` must have a bounded number
    of values (here: the capacity). The slices are written before they are counted, so a task
    that is run again finds the same ones.
    """
    if all(n <= most for n in counts.values()):
        return df.withColumn("rank", (F.row_number().over(W.partitionBy(group).orderBy(*order)) - 1).cast("long"))
    slices = [(g, -(-n // most)) for g, n in counts.items()]
    sizes = df.sparkSession.createDataFrame(slices, "__g long, __slices long")
    salt = F.xxhash64(*order, F.monotonically_increasing_id())
    cut = df.join(F.broadcast(sizes), F.col(group) == F.col("__g")).withColumn("__slice", F.pmod(salt, F.col("__slices"))).drop("__g", "__slices")
    sliced = materialise(cut, "slices", keep=True)
    before = sliced.groupBy(group, "__slice").count().select(
        F.col(group).alias("__g"), F.col("__slice").alias("__s"),
        (F.sum("count").over(W.partitionBy(group).orderBy("__slice")) - F.col("count")).alias("__before"),
    )
    place = F.row_number().over(W.partitionBy(group, "__slice").orderBy(*order))
    return (
        sliced.withColumn("__place", place)
        .join(before, (F.col(group) == F.col("__g")) & (F.col("__slice") == F.col("__s")))
        .withColumn("rank", F.col("__before") + F.col("__place") - 1)
        .drop("__slice", "__place", "__g", "__s", "__before")
    )


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to written pieces (doc_id, piece, length, ids_crc32, ...).

    The histogram (``capacity`` rows at most) is all that the driver sees. The plan's runs are
    broadcast: a range of sequences is split at most once a length, so there are few of them.
    Repeated rows are packed each. An empty table gives no rows.
    """
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    runs = plan(counts, capacity)
    spark = parts.sparkSession
    held = spark.sparkContext.broadcast(runs[np.lexsort((runs[:, 1], runs[:, 0]))])
    span = int(max(counts.values(), default=0)) + 1  # length * span + rank orders the runs
    ranked = with_rank(parts, "length", ["doc_id", "piece", "ids_crc32"], counts)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = held.value
        keys = r[:, 0] * span + r[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(c), np.int64) for c in ("length", "rank"))
            own = r[np.searchsorted(keys, length * span + rank, side="right") - 1]
            k = rank - own[:, 1]
            cols = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "rank"]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(own[:, 3] + k // own[:, 4]), pa.array(own[:, 5] + k % own[:, 4] * length)],
                [*names, "sequence_id", "offset"],
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return ranked.mapInArrow(slots, f"{kept}, sequence_id long, offset long")


def packed_sequences(docs: DataFrame, capacity: int = CAPACITY, ranks_path: str | None = None) -> DataFrame:
    """The token sequences themselves: (sequence_id, n_tokens, ids as bytes, doc_ids)."""
    parts = pack(materialise(pieces(docs, capacity, ranks_path, with_ids=True), "pieces"), capacity)
    row = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return parts.groupBy("sequence_id").agg(row.alias("r")).select(
        "sequence_id",
        F.expr("aggregate(r, 0L, (n, x) -> n + octet_length(x.ids) div 4)").alias("n_tokens"),
        F.expr("aggregate(r, cast('' as binary), (b, x) -> b || x.ids)").alias("ids"),
        F.col("r.doc_id").alias("doc_ids"),
    )


def op9_histogram_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    written = materialise(pieces(table(spark, sf_dir, "documents")), "pieces")
    return pack(written).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
