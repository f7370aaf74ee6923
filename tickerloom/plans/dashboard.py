"""What users ask, answered for all users in one job.

Every query takes plain frames; to answer for one user, filter ``users`` and ``user_stock`` first:
scopes are per user, so the result is the same.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.mood import indicator, mood_bucket, mood_label
from ..functions.time import as_of_like, in_window, month_day, relative_age, status_label
from ..operators import rank, scope
from ..sources.bucketed import bucketed
from ..sources.headlines import HeadlineIndex
from ..sources.seed import MARKET_ICONS, OTHER_ICON
from ..sources.storage import written


@dataclass
class Tables:
    """The frames that the queries read; latest readings are derived once and reused."""

    users: DataFrame
    stock: DataFrame
    market: DataFrame
    article: DataFrame
    article_stock: DataFrame
    sentiment: DataFrame
    user_stock: DataFrame
    user_market: DataFrame

    def __post_init__(self) -> None:
        self.latest = rank.latest_sentiment(self.sentiment)


def bucketed_by_stock(t: Tables, buckets: int) -> Tables:
    """The tables that queries join by stock, in buckets of it: latest readings, histories and
    watched stocks are then made without moving these tables."""
    own = {n: bucketed(getattr(t, n), n, "stock_id", buckets) for n in ("stock", "sentiment", "user_stock", "article_stock")}
    return replace(t, **own)


def watch_latest(t: Tables) -> DataFrame:
    """(user_id, stock_id, ticker, market_id, score, date) of all watched stocks; no reading, nulls."""
    return t.user_stock.join(t.stock, "stock_id").join(t.latest.select("stock_id", "score", "date"), "stock_id", "left")


def portfolio_mood(t: Tables) -> DataFrame:
    """Mean latest score over the user's stocks that have one; null without any."""
    means = watch_latest(t).groupBy("user_id").agg(F.avg("score").alias("score"))
    return t.users.select("user_id").join(means, "user_id", "left").select("user_id", "score", mood_label(F.col("score")).alias("label"))


def watchlist_size(t: Tables) -> DataFrame:
    sizes = t.user_stock.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return t.users.select("user_id").join(sizes, "user_id", "left").select("user_id", F.coalesce("n", F.lit(0)).alias("watchlist_size"))


def overview(t: Tables, as_of: datetime) -> DataFrame:
    """Watchlist size, articles of the last day, readings, last update, portfolio score and label."""
    own = watch_latest(t).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("watchlist_size"), F.count("score").alias("readings"), F.max("date").alias("last_update"),
        F.avg("score").alias("portfolio_score"),
    )
    counted = scope.articles_24h(t.users, t.article_stock, t.article, t.user_stock, as_of)
    return counted.join(own, "user_id", "left").select(
        "user_id", F.coalesce("watchlist_size", F.lit(0)).alias("watchlist_size"), "articles_24h",
        F.coalesce("readings", F.lit(0)).alias("readings"), "last_update", "portfolio_score",
        mood_label(F.col("portfolio_score")).alias("label"),
    )


def top_movers(t: Tables, k: int = 3) -> DataFrame:
    return rank.top_movers(watch_latest(t), k).select(
        "user_id", "side", "rank", "stock_id", "ticker", "score", mood_label(F.col("score")).alias("label")
    )


def overview_headlines(t: Tables, as_of: datetime, k: int = 5, tickers: int = 3) -> DataFrame:
    """The newest ``k`` headlines in each user's scope, with their first tickers and age."""
    scoped = scope.users_with_articles(t.article_stock, t.user_stock)
    newest = written(scope.stock_newest(t.article_stock, t.article, k), "stock-newest")
    rows = scope.scoped_newest(t.users, scoped, newest, t.article, t.user_stock, k)
    now = as_of_like(t.article, "published_at", as_of)
    shown = rows.join(t.article.select("article_id", "headline"), "article_id")
    facts = scope.article_facts(t.article_stock, t.stock, only=scope.showable(newest, t.article, k))
    return shown.join(facts, "article_id", "left").select(
        "user_id", "rank", "article_id", "headline",
        F.array_join(F.slice(F.coalesce("tickers", F.array().cast("array<string>")), 1, tickers), ",").alias("tickers"),
        relative_age(F.col("published_at"), now).alias("age"),
    )


def news_feed(
    t: Tables, as_of: datetime, limit: int | str | None = None, window: str = "all", query: str | None = None,
    ticker: str | None = None, mood: str | None = None, tickers: int = 4, index: HeadlineIndex | None = None,
) -> DataFrame:
    """Each user's feed: newest articles, strongest sentiment, first tickers, ``has_more``.

    Users with a watchlist see its articles, others all; a ticker overrides that for everyone.
    A page is made once for each different watchlist, and once for all others, and hung on its users.
    With a mood, four times as many are fetched and filtered afterwards, so older matches may
    stay unseen. ``has_more`` is true whenever the page is full and may grow. What the result reads
    outlives the caller's ``scratch``.
    """
    n = scope.clamp_limit(limit)
    fetch = min(scope.MOST_FETCHED, n * scope.OVER_FETCH if mood else n)
    articles = scope.headline_contains(in_window(t.article, "published_at", as_of, window), query, index)
    if ticker:
        articles = scope.scope_ticker(articles, t.article_stock, t.stock, ticker)
    everyones = written(scope.global_newest(articles, fetch).drop("published_at"), "newest", keep=True)
    scoped = not ticker
    if scoped:
        shown = written(scope.stock_newest(t.article_stock, articles, fetch), "stock-newest")
    ids = everyones.select("article_id").unionByName(shown.select("article_id")).distinct() if scoped else everyones
    facts = scope.article_facts(t.article_stock, t.stock, t.latest, ids)
    facts = written(
        facts.select("article_id", "score", mood_bucket(F.col("score")).alias("bucket"), F.array_join(F.slice("tickers", 1, tickers), ",").alias("tickers")), "facts", keep=True
    )

    def told(rows: DataFrame, *names: str) -> DataFrame:
        """Rows with these facts of their articles; an article without a stock has no mood and no tickers."""
        none = {"bucket": F.coalesce("bucket", mood_bucket(F.lit(None))), "tickers": F.coalesce("tickers", F.lit(""))}
        return rows.join(facts.select("article_id", *names), "article_id", "left").withColumns({c: none[c] for c in names if c in none})

    def fitting(rows: DataFrame) -> DataFrame:
        return told(rows, "bucket").withColumn("fits", F.col("bucket") == mood).drop("bucket")

    def page(rows: DataFrame, *group: str) -> DataFrame:
        """The first n rows of each group."""
        place = W.partitionBy(*group)
        if mood:
            rows = rows.withColumn("rank", F.row_number().over(place.orderBy("rank"))).where(F.col("rank") <= n)
        full = (F.count(F.lit(1)).over(place) >= n) & F.lit(n < scope.MOST)
        return rows.select(*group, "rank", "article_id", full.alias("has_more"))

    names, columns = ("score", "bucket", "tickers"), ("user_id", "rank", "article_id", "score", "bucket", "tickers", "has_more")
    rest = t.users.select("user_id")
    if scoped:
        members, sets = scope.watch_sets(t.user_stock)
        # whether an article has the mood goes with it, so that others are left out before anything else is joined
        shown = written(fitting(shown), "stock-fitting") if mood else shown
        own = scope.user_newest(shown, sets, fetch, user="set_id", wanted="fits" if mood else None).drop("published_at")
        rest = rest.join(members.select("user_id"), "user_id", "left_anti")
    general = told(page(fitting(everyones).where("fits") if mood else everyones), *names)
    shared = rest.crossJoin(F.broadcast(general)).select(*columns)  # at most n rows for all
    return told(page(own, "set_id").join(members, "set_id"), *names).select(*columns).unionByName(shared) if scoped else shared


def feed_summary(feed: DataFrame) -> DataFrame:
    """Rows shown to each user and whether there may be more."""
    return feed.groupBy("user_id").agg(F.count(F.lit(1)).alias("shown"), F.max("has_more").alias("has_more"))


def stock_detail(t: Tables, ticker: str | None = None, readings: int = 30, articles: int = 20) -> DataFrame:
    """Market, latest score, and counts over the last 30 readings and 20 articles of each stock.

    ``first_reading`` is the oldest of those readings, not of all.
    """
    stocks = t.stock if ticker is None else scope.find_stock(t.stock, ticker)
    history = rank.sentiment_history(t.sentiment, readings).groupBy("stock_id").agg(
        F.count(F.lit(1)).alias("n_readings"), F.min("date").alias("first_reading")
    )
    newest = rank.stock_articles(t.article_stock, t.article.select("article_id", "published_at"), articles)
    counted = newest.groupBy("stock_id").agg(F.count(F.lit(1)).alias("n_articles"))
    return (
        stocks.join(t.market.select("market_id", F.col("name").alias("market")), "market_id")
        .join(t.latest.select("stock_id", "score"), "stock_id", "left")
        .join(history, "stock_id", "left")
        .join(counted, "stock_id", "left")
        .select(
            "stock_id", "ticker", "market", "score", mood_label(F.col("score")).alias("label"),
            F.coalesce("n_readings", F.lit(0)).alias("n_readings"), F.coalesce("n_articles", F.lit(0)).alias("n_articles"), "first_reading",
        )
    )


def stock_articles(t: Tables, n: int = 20) -> DataFrame:
    """The newest articles of each stock; the badge is the stock's latest score on all of them."""
    rows = rank.stock_articles(t.article_stock, t.article.select("article_id", "published_at"), n)
    return rows.join(t.latest.select("stock_id", "score"), "stock_id", "left").select(
        "stock_id", "rank", "article_id", "published_at", mood_bucket(F.col("score")).alias("badge")
    )


def stock_history(t: Tables, n: int = 30) -> DataFrame:
    """The last readings of each stock in chronological order: pos 1 is the oldest."""
    rows = rank.sentiment_history(t.sentiment, n)
    pos = F.row_number().over(W.partitionBy("stock_id").orderBy(F.desc("rank")))
    return rows.select("stock_id", pos.alias("pos"), "sentiment_id", "date", month_day(F.col("date")).alias("day"), "score", F.round("score", 3).alias("score_3"))


def sentiment_board(t: Tables, n: int = 30) -> DataFrame:
    """Watched stocks of each user by latest score, none last; a missing score shows as 0, Neutral."""
    counts = rank.sentiment_history(t.sentiment, n).groupBy("stock_id").agg(F.count(F.lit(1)).alias("readings"))
    rows = watch_latest(t).join(counts, "stock_id", "left")
    order = W.partitionBy("user_id").orderBy(F.desc_nulls_last("score"), F.asc("ticker"))
    shown = F.coalesce("score", F.lit(0.0))
    return rows.select(
        "user_id", F.row_number().over(order).alias("rank"), "ticker", shown.alias("shown_score"), mood_label(shown).alias("label"),
        F.coalesce("readings", F.lit(0)).alias("readings"), (F.coalesce("readings", F.lit(0)) > 1).alias("trend"),
    )


def watchlist(t: Tables) -> DataFrame:
    """Watched stocks of each user by ticker, with market and badge."""
    rows = watch_latest(t).join(t.market.select("market_id", F.col("name").alias("market")), "market_id")
    order = W.partitionBy("user_id").orderBy("ticker", "stock_id")
    return rows.select("user_id", F.row_number().over(order).alias("rank"), "ticker", "market", "score", mood_bucket(F.col("score")).alias("bucket"), indicator(F.col("score")).alias("badge"))


def markets_board(t: Tables) -> DataFrame:
    """All markets for each user with a followed flag and icon; markets are few and broadcast by size."""
    icon = F.lit(OTHER_ICON)
    for name, sign in MARKET_ICONS.items():
        icon = F.when(F.col("name") == name, sign).otherwise(icon)
    followed = t.user_market.select("user_id", "market_id").distinct().withColumn("__f", F.lit(True))
    pairs = t.users.select("user_id").crossJoin(t.market.select("market_id", "name"))
    return pairs.join(followed, ["user_id", "market_id"], "left").select(
        "user_id", "market_id", "name", F.coalesce("__f", F.lit(False)).alias("followed"), icon.alias("icon")
    )


def market_lists(t: Tables) -> DataFrame:
    """(user_id, followed, others): ids of the markets that a user follows and of the rest, in order.

    One row a user instead of one for each market: only follows move, the list of all markets is
    one row.
    """
    every = t.market.agg(F.array_sort(F.collect_set("market_id")).alias("every"))  # markets are few
    known = t.user_market.join(t.market.select("market_id"), "market_id", "left_semi")
    own = known.groupBy("user_id").agg(F.array_sort(F.collect_set("market_id")).alias("own"))
    rows = t.users.select("user_id").join(own, "user_id", "left").crossJoin(F.broadcast(every))
    mine = F.coalesce("own", F.array_except("every", "every"))
    return rows.select("user_id", mine.alias("followed"), F.array_except("every", mine).alias("others"))


def is_followed(t: Tables, stock_ids: DataFrame) -> DataFrame:
    """(user_id, stock_id, followed) for asked pairs."""
    own = t.user_stock.select("user_id", "stock_id").distinct().withColumn("followed", F.lit(True))
    return stock_ids.join(own, ["user_id", "stock_id"], "left").withColumn("followed", F.coalesce("followed", F.lit(False)))


def pipeline_status(t: Tables, as_of: datetime) -> DataFrame:
    """When the newest reading of all was made, as a label; ``Never run`` for an empty table."""
    now = as_of_like(t.sentiment, "date", as_of)
    return t.sentiment.agg(F.max("date").alias("last_run")).select("last_run", status_label(F.col("last_run"), now).alias("label"))
