"""Sharding by weighted rendezvous hashing of stable record keys. DataFrame functions only.

Every shard draws a number for every key from ``md5(key:shard)``; the shard with the least
``-ln(u) / weight`` takes the record. A shard that is added draws numbers of its own and wins
its share; no record moves between the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, table

#: 13 hex digits of the digest are a number below 2**52, exact in a double.
DRAW_DIGITS, DRAW_RANGE = 13, float(2**52)


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) fixed by key and shard."""
    digest = F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("double") + 0.5) / DRAW_RANGE


def _winner(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """(bid, shard) of the shard that wins ``key``; the weights are those of shards ``first``, ..."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    bids = [
        F.struct((-F.log(draw(text, s)) / F.lit(float(w))).alias("bid"), F.lit(s).alias("shard"))
        for s, w in enumerate(weights, first)
        if w > 0
    ]
    return F.least(*bids) if len(bids) > 1 else bids[0]


def _checked(weights: Sequence[float]) -> None:
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must be 0 or more, one of them over 0")


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0-based) that wins ``key``; shards of weight 0 win nothing.

    A null key counts as the text ``null``. Ties go to the lower shard.
    """
    _checked(weights)
    return _winner(key, weights)["shard"]


SLICES = 256


def with_slots(df: DataFrame, shard: str, order: Sequence[str], slices: int = SLICES) -> DataFrame:
    """Add ``slot``: places 0, 1, ... without gaps inside each shard.

    A shard is never ordered in one task: rows are numbered inside ``slices`` slices of it, and
    the rows in earlier slices are added. The slice comes from all ``order`` columns, so the rows
    of one key are spread. Slice sizes are counted in a first pass; that table has shards * slices
    rows at most, so it is broadcast. Rows that agree in every ``order`` column take neighbouring
    slots in any order. Empty input gives empty output. Other columns stay as they are; ``slot`` and
    names that begin with two underscores (``__slice``, ``__place``, ...) are the operator's own.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in order])
    drawn = F.conv(F.substring(F.md5(key.cast("binary")), 1, 4), 16, 10).cast("int")
    cut = df.withColumn("__slice", drawn % slices)
    before = (
        cut.groupBy(shard, "__slice")
        .count()
        .select(
            F.col(shard).alias("__shard"),
            F.col("__slice").alias("__s"),
            (F.sum("count").over(W.partitionBy(shard).orderBy("__slice")) - F.col("count")).alias("__before"),
        )
    )
    place = F.row_number().over(W.partitionBy(shard, "__slice").orderBy(*order))
    return (
        cut.withColumn("__place", place)
        .join(F.broadcast(before), (F.col(shard) == F.col("__shard")) & (F.col("__slice") == F.col("__s")))
        .withColumn("slot", F.col("__before") + F.col("__place") - 1)
        .drop("__slice", "__shard", "__s", "__before", "__place")
    )


def shard_records(
    df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None
) -> DataFrame:
    """All columns of ``df`` plus ``shard`` and, for another weight list, ``grown_shard``.

    Own columns named ``shard`` or ``grown_shard`` are replaced. Repeated keys go together; texts,
    however long, are not looked at. Where
    ``grown`` only adds shards, these alone draw anew and bid against the winner.
    """
    _checked(weights)
    won = df.withColumn("__won", _winner(F.col(key), weights))
    out = won.withColumn("shard", F.col("__won.shard"))
    if grown is not None:
        _checked(grown)
        n, more = len(weights), grown[len(weights) :]
        if list(grown[:n]) != list(weights):
            out = out.withColumn("grown_shard", rendezvous(F.col(key), grown))
        elif any(w > 0 for w in more):
            out = out.withColumn("grown_shard", F.least(F.col("__won"), _winner(F.col(key), more, n))["shard"])
        else:
            out = out.withColumn("grown_shard", F.col("shard"))
    return out.drop("__won")


SHARDS = 40


def op10_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 39, and where each would go with 41 shards.

    A null text has no bytes; a null doc_id counts as the text ``null``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    # written: the draws are made once, and both passes over the slices read four numbers a row
    placed = materialise(shard_records(docs, "doc_id", [1.0] * SHARDS, [1.0] * (SHARDS + 1)), "placed")
    return with_slots(placed, "shard", ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), "grown_shard",
    )


#: DuckDB has no crc32; it is folded over the bytes with the usual reflected polynomial.
ORACLE_SQL = f"""
WITH RECURSIVE step(n, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8
), crcs AS (
  SELECT list(c ORDER BY n) AS crc_table FROM step WHERE k = 8
), d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k FROM documents
), b AS (
  SELECT doc_id, t, k,
         list_transform(range({SHARDS + 1}), lambda s: -ln((CAST('0x' || substr(md5(k || ':' || CAST(s AS VARCHAR)), 1, {DRAW_DIGITS}) AS BIGINT) + 0.5) / {DRAW_RANGE})) AS bids,
         list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes
  FROM d
), placed AS (
  SELECT doc_id, k, CAST(strlen(t) + 16 AS BIGINT) AS size,
         xor(list_reduce(list_prepend(4294967295, bytes), lambda crc, x: xor(crc >> 8, crc_table[(xor(crc, x) & 255) + 1])), 4294967295) AS text_crc32,
         CAST(list_position(bids[1:{SHARDS}], list_min(bids[1:{SHARDS}])) - 1 AS INTEGER) AS shard,
         CAST(list_position(bids, list_min(bids)) - 1 AS INTEGER) AS grown_shard
  FROM b, crcs
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5(k || ':' || size || ':' || text_crc32), 1, 4) AS BIGINT) % {SLICES}, doc_id, size, text_crc32) - 1 AS slot
FROM placed
"""
