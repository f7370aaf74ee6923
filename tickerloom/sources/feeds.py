"""Readers of landed feed files and stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas

CATEGORIES = ("general", "forex", "crypto", "merger")
PARTITIONED_NEWS = f"{schemas.NEWS}, ticker string, dt date"


def arrival() -> Column:
    """Where a record came in: by file name, place of the split in the file, place in the split.

    Files are named by time of landing, so this orders the records of a feed as they arrived.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")
    )


def landed(read: Callable[..., DataFrame], *args, **kw) -> tuple[DataFrame | None, str | None]:
    """(frame, None), or (None, why) if the feed cannot be read: one feed does not stop the others."""
    try:
        return read(*args, **kw), None
    except AnalysisException as e:
        return None, str(e).splitlines()[0]


def read_market_news(spark: SparkSession, path: str, category: str = "general") -> DataFrame:
    """General news of one category with ``pos``, the order of arrival; folders ``category=...`` are
    pruned if there are any."""
    if category not in CATEGORIES:
        raise ValueError(f"category must be one of {CATEGORIES}")
    return spark.read.schema(schemas.NEWS).json(path).where(F.col("category") == category).withColumn("pos", arrival())


def read_company_news(spark: SparkSession, path: str, from_date: str, to_date: str) -> DataFrame:
    """News by ticker for dates from ``from_date`` to ``to_date``, both included.

    Files lie in folders ``ticker=.../dt=...``, so other dates are never opened.
    """
    rows = spark.read.schema(PARTITIONED_NEWS).json(path).where(F.col("dt").between(F.lit(from_date).cast("date"), F.lit(to_date).cast("date")))
    return rows.withColumn("pos", arrival())


def read_tagged_news(spark: SparkSession, path: str, published_after=None) -> DataFrame:
    """Articles of tagged-news responses with their entities; a response without data gives none.

    ``published_after`` counts whole minutes, as requests to the feed do.
    """
    rows = spark.read.schema(schemas.TAGGED).json(path).select(F.explode("data").alias("a"), "_metadata").select("a.*", arrival().alias("pos"))
    if published_after is None:
        return rows
    least = F.date_trunc("minute", F.lit(published_after))
    return rows.where(F.try_to_timestamp("published_at") >= least)


def read_symbol_search(spark: SparkSession, path: str) -> DataFrame:
    """Search results in order of arrival: (query_file, pos, description, displaySymbol, symbol, type)."""
    raw = spark.read.schema(schemas.SYMBOLS).json(path)
    return raw.select(F.input_file_name().alias("query_file"), F.posexplode("result").alias("pos", "r")).select(
        "query_file", "pos", "r.*"
    )


def load_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The nine tables, each a Parquet folder."""
    return {name: spark.read.schema(s).parquet(f"{folder}/{name}") for name, s in schemas.TABLES.items()}
