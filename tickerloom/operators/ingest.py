"""Feeds to tables: validate, normalise, insert what is new, link to stocks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import route_feed
from ..functions.time import from_epoch_seconds, from_iso
from ..sources.schemas import CORRUPT
from .rank import dedupe_first, numbered

ARTICLE = ("url", "headline", "summary", "source", "published_at")


def valid_articles(df: DataFrame, required: Sequence[str] = ("url", "headline")) -> DataFrame:
    """Rows whose required texts are neither null nor empty; blanks are text."""
    for c in required:
        df = df.where(F.length(c) > 0)
    return df


def invalid_articles(df: DataFrame, feed: str, required: Sequence[str] = ("url", "headline")) -> DataFrame:
    """Rejects of the rows that ``valid_articles`` leaves out."""
    good = F.lit(True)
    for c in required:
        good = good & (F.coalesce(F.length(c), F.lit(0)) > 0)
    return df.where(~good).select(
        F.lit(feed).alias("stage"), F.col("url").cast("string").alias("key"), F.lit(f"{' or '.join(required)} is missing").alias("message")
    )


def unreadable(df: DataFrame, feed: str) -> DataFrame:
    """Rejects of the records that are no JSON, by their text."""
    if CORRUPT not in df.columns:
        return df.sparkSession.createDataFrame([], "stage string, key string, message string")
    return df.where(F.col(CORRUPT).isNotNull()).select(F.lit(feed).alias("stage"), F.col(CORRUPT).alias("key"), F.lit("no JSON").alias("message"))


def normalize_news(df: DataFrame) -> DataFrame:
    """General and company news as articles; other columns are kept behind."""
    own = [F.col(c) for c in df.columns if c not in ("headline", "summary", "url", "source", "datetime")]
    return df.select("url", "headline", "summary", "source", from_epoch_seconds(F.col("datetime")).alias("published_at"), *own)


def normalize_tagged(df: DataFrame) -> DataFrame:
    """Tagged news as articles with their entities."""
    return df.select(
        "url", F.col("title").alias("headline"), F.col("description").alias("summary"), "source",
        from_iso(F.col("published_at")).alias("published_at"), "entities", *[c for c in ("batch", "pos") if c in df.columns],
    )


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """Article columns of several feeds, with ``feed_rank`` in the order given and ``pos``.

    ``pos`` is a reader's order of arrival, or a number; in a feed without one all rows are equal.
    """
    parts = []
    for rank, feed in enumerate(feeds):
        kind = feed.schema["pos"].dataType.typeName() if "pos" in feed.columns else None
        number = F.col("pos").cast("long") if kind else F.lit(0).cast("long")
        place = F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("start"), number.alias("row"))
        parts.append(feed.select(*ARTICLE, F.lit(rank).alias("feed_rank"), (F.col("pos") if kind == "struct" else place).alias("pos")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def insert_new_articles(existing: DataFrame, batch: DataFrame, order: Sequence[str] = ("feed_rank", "pos")) -> DataFrame:
    """Rows of ``batch`` to append: the first of each url by ``order`` that is not stored yet.

    Ids are hashes of urls, so a rerun makes the same ids. Rows that a table would refuse (null
    headline, source or time) are the caller's to sift out; see ``split_storable``.
    """
    keep = [c for c in batch.columns if c not in ("feed_rank", "pos")]
    ties = [c for c in keep if c != "url" and c not in order]
    first = dedupe_first(batch, ["url"], [*order, *ties]).select(*keep)
    return first.join(existing.select("url"), "url", "left_anti").withColumn("article_id", F.sha2("url", 256))


def split_storable(batch: DataFrame, required: Sequence[str] = ("url", "headline", "source", "published_at")) -> tuple[DataFrame, DataFrame]:
    """(rows that can be stored, rejects): a bad row costs itself, not its batch."""
    good = F.lit(True)
    for c in required:
        good = good & F.col(c).isNotNull()
    rejects = batch.where(~good).select(
        F.lit("store").alias("stage"), F.col("url").cast("string").alias("key"), F.lit("a required field is null").alias("message")
    )
    return batch.where(good), rejects


def insert_new_links(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Distinct (article_id, stock_id) of ``batch`` that are not stored yet."""
    keys = ["article_id", "stock_id"]
    return batch.select(*keys).distinct().join(existing.select(*keys), keys, "left_anti")


def append_sentiment(scored: DataFrame, as_of: datetime) -> DataFrame:
    """Readings to append, all dated ``as_of``."""
    now = F.lit(as_of).cast("timestamp")
    return scored.select(
        F.sha2(F.concat_ws("|", F.col("stock_id").cast("string"), now.cast("string")), 256).alias("sentiment_id"),
        "stock_id", "score", "summary", now.alias("date"), now.alias("created_at"),
    )


def resolve_article_ids(batch: DataFrame, articles: DataFrame) -> DataFrame:
    """Rows of ``batch`` with the article_id of their url, stored before or just now."""
    return batch.join(articles.select("url", "article_id"), "url")


def link_primary(news: DataFrame, stocks: DataFrame, articles: DataFrame) -> DataFrame:
    """Attempted (article_id, stock_id) of company news: each article and its feed's ticker."""
    own = news.select("ticker", "url").distinct().join(stocks.select("ticker", "stock_id"), "ticker")
    return resolve_article_ids(own, articles).select("article_id", "stock_id")


def request_batches(stocks: DataFrame, size: int = 5) -> DataFrame:
    """(ticker, stock_id, batch): which request of ``size`` symbols asks for each of the tagged feed's
    stocks, by the order of their tickers."""
    return numbered(stocks.select("ticker", "stock_id"), ["ticker", "stock_id"]).select("ticker", "stock_id", F.expr(f"place div {size}").alias("batch"))


def link_entities(tagged: DataFrame, stocks: DataFrame, articles: DataFrame) -> DataFrame:
    """Attempted (article_id, stock_id) of tagged news: entities that name a ticker exactly.

    Where ``tagged`` has the ``batch`` of its request and ``stocks`` theirs (see ``request_batches``),
    an entity that the request did not ask for is not linked; nor is any of a null batch. A url that is
    not stored is skipped. An entity listed twice counts twice.
    """
    on = [c for c in ("batch",) if c in tagged.columns and c in stocks.columns]
    named = tagged.select("url", F.explode("entities.symbol").alias("symbol"), *on)
    named = named.join(stocks.select(F.col("ticker").alias("symbol"), "stock_id", *on), ["symbol", *on])
    return resolve_article_ids(named.select("url", "stock_id"), articles).select("article_id", "stock_id")


def feed_of(stocks: DataFrame, feed: str) -> DataFrame:
    return stocks.where(route_feed(F.col("ticker")) == feed)
