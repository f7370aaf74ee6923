"""Quality rules by compression bands: zstandard ratios of documents and fixed chunks.

Text that repeats itself compresses too well, noise too little. Short texts compress less, so
each length class has a band of its own. Limits are parameters, not learned from the input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Bands:
    """Lowest and highest ratio (bytes over compressed bytes) by length in bytes.

    ``document`` and ``chunk`` are lists of (shorter than, lowest, highest), the last without a
    length limit. A document fails when its own ratio leaves its band, or when chunks that leave
    theirs hold more than ``bad_share`` of its bytes. Chunks have ``chunk_bytes`` bytes; the rest
    at the end is a shorter chunk with a band of its own, so every byte is in one. A document no
    longer than a chunk is judged as a document only.
    """

    document: tuple[tuple[float, float, float], ...] = (
        (200, 0.5, 3.0),
        (500, 0.9, 3.2),
        (2_000, 1.2, 3.6),
        (8_000, 1.4, 4.2),
        (float("inf"), 1.5, 5.0),
    )
    chunk: tuple[tuple[float, float, float], ...] = (
        (64, 0.3, 3.0),
        (256, 0.5, 3.2),
        (1_024, 0.9, 3.6),
        (float("inf"), 1.2, 4.0),
    )
    chunk_bytes: int = 2_048
    bad_share: float = 0.5
    level: int = 3


def _limits(bands: tuple[tuple[float, float, float], ...], n: int) -> tuple[float, float]:
    return next((low, high) for shorter, low, high in bands if n < shorter)


def chunk_ratios(raw: bytes, bands: Bands, pack: zstandard.ZstdCompressor) -> list[tuple[int, float]]:
    size = bands.chunk_bytes
    if len(raw) <= size:
        return []
    cuts = [raw[i : i + size] for i in range(0, len(raw), size)]
    return [(len(c), len(c) / len(pack.compress(c))) for c in cuts]


def judge(raw: bytes, bands: Bands, pack: zstandard.ZstdCompressor) -> tuple[float, float, str]:
    """(ratio, share of bytes in chunks outside their band, verdict); empty bytes have ratio 0."""
    if not raw:
        return 0.0, 0.0, "empty"
    ratio = len(raw) / len(pack.compress(raw))
    low, high = _limits(bands.document, len(raw))
    parts = chunk_ratios(raw, bands, pack)
    share = sum(n for n, r in parts for a, b in [_limits(bands.chunk, n)] if not a <= r <= b) / len(raw)
    if ratio > high:
        return ratio, share, "repetitive"
    if ratio < low:
        return ratio, share, "incompressible"
    return ratio, share, "chunks" if share > bands.bad_share else "ok"




def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dup = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line.strip(BLANKS):
                dup += line in seen
                seen.add(line)
    return len(words), chars, symbols, dup, repeated_words(words)


def repeated_words(words: list[bytes], n: int = 3) -> int:
    """Words inside n-word windows that occur twice or more."""
    if len(words) <= n:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    key = seq[: 1 - n] if n > 1 else seq
    for i in range(1, n):
        pair = key * len(ids) + seq[i : len(seq) - n + 1 + i]
        # ranks keep the key small, whatever the vocabulary
        key = np.unique(pair, return_inverse=True)[1] if i < n - 1 and len(ids) > 2_000_000 else pair
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[back] > 1)
    hit = np.zeros(len(words), bool)
    for i in range(n):
        hit[starts + i] = True
    return int(hit.sum())


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "ratio double, chunk_share double, verdict string"
)


def compression_quality(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): base counts, ratios and a verdict.

    A null text is an empty text: all counts 0, verdict ``empty``. Repeated rows are judged one
    by one; an empty table gives no rows; other columns are ignored. A very long
    text is compressed whole, and in all its chunks. One pass, no shuffle; a task holds one Arrow batch.
    """

    def rows(batch: pa.RecordBatch) -> dict[str, list]:
        pack = zstandard.ZstdCompressor(level=bands.level)
        out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
        out["doc_id"] = batch.column("doc_id")
        for value in batch.column("text"):
            text = value.as_py() or ""
            ratio, share, verdict = judge(text.encode("utf-8", "surrogatepass"), bands, pack)
            for name, x in zip(list(out)[1:], (*base_counts(text), ratio, share, verdict), strict=True):
                out[name].append(x)
        return out

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), SCHEMA, rows)


def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every whole text of documents."""
    judged = compression_quality(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("verdict") == "ok")).alias("kept"),
        "ratio", "chunk_share", "verdict",
    )
