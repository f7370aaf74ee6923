"""Latest and top-k rows per group. Every order ends with a key, so results repeat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import written


def latest_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` of each group, by one aggregate with map-side combine."""
    best = F.max_by(F.struct(*keep), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__best")).select(*keys, "__best.*")


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their rank from 1.

    Spark cuts groups before the shuffle for k up to ``windowGroupLimitThreshold`` (1000).
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key, the first by ``order``."""
    others = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*others), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__best")).select(*keys, "__best.*").select(*df.columns)


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key, the last by ``order``."""
    others = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__best")).select(*keys, "__best.*").select(*df.columns)


def latest_sentiment(sentiment: DataFrame) -> DataFrame:
    """(stock_id, sentiment_id, score, date) of the newest reading of each stock; of readings at
    one time the smallest id."""
    order = [F.col("date"), -F.col("sentiment_id")] if _numeric(sentiment, "sentiment_id") else [F.col("date"), F.col("sentiment_id")]
    return latest_per_group(sentiment, ["stock_id"], order, ["sentiment_id", "score", "date"])


def sentiment_history(sentiment: DataFrame, n: int = 30) -> DataFrame:
    """The last ``n`` readings of each stock, rank 1 the newest."""
    return top_k_per_group(sentiment, ["stock_id"], [F.desc("date"), F.asc("sentiment_id")], n)


def stock_articles(links: DataFrame, articles: DataFrame, n: int = 20) -> DataFrame:
    """The newest ``n`` articles of each stock."""
    both = links.join(articles, "article_id")
    return top_k_per_group(both, ["stock_id"], [F.desc("published_at"), F.asc("article_id")], n)


def top_sentiment(links: DataFrame, latest: DataFrame) -> DataFrame:
    """(article_id, stock_id, score): the strongest latest reading among an article's stocks.

    Strongest is the largest absolute score, its sign kept; of equal ones the smallest stock.
    """
    order = F.struct(-F.abs("score"), "stock_id")
    best = F.min_by(F.struct("stock_id", "score"), order)
    return (
        links.join(latest.where("score is not null").select("stock_id", "score"), "stock_id")
        .groupBy("article_id")
        .agg(best.alias("b"))
        .select("article_id", "b.stock_id", "b.score")
    )


def top_movers(scored: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` highest and lowest scores of each user; with few stocks a stock may be in both."""
    rows = scored.where("score is not null")
    bulls = top_k_per_group(rows, ["user_id"], [F.desc("score"), F.asc("stock_id")], k).withColumn("side", F.lit("bull"))
    bears = top_k_per_group(rows, ["user_id"], [F.asc("score"), F.asc("stock_id")], k).withColumn("side", F.lit("bear"))
    return bulls.unionByName(bears)


def numbered(df: DataFrame, order: Sequence[str], column: str = "place") -> DataFrame:
    """Add ``column``: 0, 1, ... in ascending order of columns that tell rows apart.

    Rows are sorted in ranges, and of each range only its number of rows is gathered, so no task
    holds the whole. Written, as both are read from it.
    """
    sorted_ = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__at", 33)
    sizes = sorted_.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__part", (F.sum("n").over(W.orderBy("__part")) - F.col("n")).alias("__before"))
    joined = sorted_.withColumn("__part", part).join(before, "__part")
    return joined.withColumn(column, F.col("__before") + F.col("__at") - F.shiftleft("__part", 33)).drop("__part", "__before", "__at")


def _numeric(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("long", "integer", "short", "byte")
