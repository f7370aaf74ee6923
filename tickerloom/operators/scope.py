"""Which stocks and articles a user sees."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import route_feed
from ..functions.time import in_window
from ..sources.headlines import HeadlineIndex
from ..sources.storage import written, written_and_counted
from .rank import top_k_per_group

DEFAULT_LIMIT, MOST, MOST_FETCHED, OVER_FETCH = 50, 500, 2000, 4


def clamp_limit(n: int | str | None) -> int:
    """A feed limit between 50 and 500; what is no number, or 0, is 50."""
    try:
        value = int(n)
    except (TypeError, ValueError):
        value = 0
    return min(MOST, max(DEFAULT_LIMIT, value or DEFAULT_LIMIT))


def next_limit(n: int) -> int:
    return min(n + DEFAULT_LIMIT, MOST)


def headline_contains(df: DataFrame, query: str | None, index: HeadlineIndex | None = None) -> DataFrame:
    """Headlines with the trimmed text in them, in any case; no text, no filter. ``_`` and ``%``
    are plain characters. With an ``index`` of the articles only what it finds is looked at."""
    text = (query or "").strip()
    if text and index is not None:
        return df.join(index.find(text).select("article_id"), "article_id", "left_semi")
    return df.where(F.lower("headline").contains(text.lower())) if text else df


def watched_stocks(stocks: DataFrame, user_stock: DataFrame) -> DataFrame:
    """Stocks that someone follows, with the feed that serves them."""
    return stocks.join(user_stock.select("stock_id"), "stock_id", "left_semi").withColumn("feed", route_feed(F.col("ticker")))


def find_stock(stocks: DataFrame, ticker: str) -> DataFrame:
    """The first stock of that ticker in any case."""
    return stocks.where(F.upper("ticker") == ticker.upper()).orderBy("ticker").limit(1)


def scope_ticker(articles: DataFrame, links: DataFrame, stocks: DataFrame, ticker: str) -> DataFrame:
    """Articles of one ticker, written exactly so; whose watchlist it is on does not matter."""
    own = links.join(stocks.where(F.col("ticker") == ticker).select("stock_id"), "stock_id", "left_semi")
    return articles.join(own.select("article_id"), "article_id", "left_semi")


def user_articles(links: DataFrame, user_stock: DataFrame) -> DataFrame:
    """(user_id, article_id): articles with a stock that the user follows, each once."""
    return links.join(user_stock, "stock_id").select("user_id", "article_id").distinct()


def stock_newest(links: DataFrame, articles: DataFrame, k: int) -> DataFrame:
    """(stock_id, article_id, published_at, place): the newest ``k`` articles of each stock."""
    return top_k_per_group(
        links.join(articles.select("article_id", "published_at"), "article_id"),
        ["stock_id"], [F.desc("published_at"), F.asc("article_id")], k, "place",
    ).select("stock_id", "article_id", "published_at", "place")


def user_floors(newest: DataFrame, user_stock: DataFrame, k: int, spare: float = 2.0) -> DataFrame:
    """(user_id, floor): a date since which the user's stocks have ``spare * k`` articles, roughly.

    The mean date of the article at place spare * k / m of each of the user's m stocks. Null, that
    is no floor, for a user whose stocks have too few articles for it to spare anything. Any floor
    gives right results; it decides only how much is looked at.
    """
    own = user_stock.groupBy("user_id").agg(F.count(F.lit(1)).alias("m"))
    held = newest.groupBy("stock_id").agg(F.count(F.lit(1)).alias("held"))
    asked = user_stock.join(own, "user_id").join(held, "stock_id").withColumn("place", F.least(F.ceil(F.lit(spare * k) / F.col("m")).cast("int"), "held"))
    at = asked.join(newest.select("stock_id", "place", "published_at"), ["stock_id", "place"])
    mean = F.timestamp_micros(F.avg(F.unix_micros(F.col("published_at").cast("timestamp"))).cast("long"))
    floors = at.groupBy("user_id").agg(mean.alias("floor"), F.sum("held").alias("all_held"))
    return floors.select("user_id", F.when(F.col("all_held") > 2 * spare * k, F.col("floor")).alias("floor"))


def watch_sets(user_stock: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(user_id, set_id) of all users with a watchlist, and (set_id, stock_id) of each different one.

    A set is named by its least user. Sets are told apart by their size and two sums over hashes of
    their stocks, 128 bits, so no watchlist is ever gathered.
    """
    own = user_stock.select("user_id", "stock_id").distinct()
    sums = [F.bit_xor(F.xxhash64("stock_id", F.lit(i))).alias(c) for i, c in enumerate(("a", "b"))]
    marked = written(own.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), *sums), "watch-marks")
    least = marked.groupBy("n", "a", "b").agg(F.min("user_id").alias("set_id"))
    members = written(marked.join(least, ["n", "a", "b"]).select("user_id", "set_id"), "watch-members", keep=True)
    named = members.where("user_id = set_id").select("set_id")
    stocks = own.join(named, F.col("user_id") == F.col("set_id")).select("set_id", "stock_id")
    return members, written(stocks, "watch-sets")


def user_newest(
    newest: DataFrame, user_stock: DataFrame, k: int, spare: float | None = None, user: str = "user_id", wanted: str | None = None, at_once: int = 1 << 27,
) -> DataFrame:
    """The newest ``k`` articles of each user's stocks: (user_id, article_id, published_at, rank).

    A user's newest k are among the newest k of each of the user's stocks, which ``newest`` is (see
    ``stock_newest``). Of these only articles since the user's floor are taken. A user who has k of them has
    the true newest k; the few who have not are looked at again without a floor. ``user`` names the
    column of whoever follows; what is looked at is written, as it is asked twice who fell short.

    Users are looked at in groups of about ``at_once`` rows, one after the other, so that what is moved
    at a time stays on the disks. ``wanted`` names a column of ``newest``, true or false of an
    article: then only those of the k for which it is true are returned.
    """
    user_stock = user_stock.withColumnRenamed(user, "user_id")
    spare = spare or min(2.0, 1 + 7 / k**0.5)  # seven: some three times the spread of what lies above a floor
    # an article that comes by several stocks has one dense rank, so it is told apart after the
    # cut; a user's rows come from many tasks, so cutting them before the shuffle would spare nothing
    order = W.partitionBy("user_id").orderBy(F.desc("published_at"), F.asc("article_id"))
    own = [wanted] if wanted else []

    def ranked(follows: DataFrame, floored: bool) -> DataFrame:
        pairs = newest.join(follows, "stock_id")
        pairs = pairs.where(F.col("floor").isNull() | (F.col("published_at") >= F.col("floor"))) if floored else pairs
        pairs = pairs.select("user_id", "article_id", "published_at", *own).repartition("user_id")
        return pairs.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).distinct()

    floors, users = written_and_counted(user_floors(newest, user_stock, k, spare), "floors")
    groups = max(1, round(users * spare * k / at_once))
    first = None
    for i in range(groups):
        group = floors.where(F.pmod(F.xxhash64("user_id"), F.lit(groups)) == i)
        rows = ranked(user_stock.join(group, "user_id"), True)
        # the row at place k tells that a user has k
        rows = written(rows.where(F.col(wanted) | (F.col("rank") == k)) if wanted else rows, "floored", keep=True)
        first = rows if first is None else first.unionByName(rows)
    reached = first.where(F.col("rank") == k).select("user_id")
    short, missing = written_and_counted(floors.where("floor is not null").select("user_id").join(reached, "user_id", "left_anti"), "short", keep=True)
    if missing:
        again = ranked(user_stock.join(short, "user_id", "left_semi"), False)
        first = first.join(short, "user_id", "left_anti").unionByName(written(again, "unfloored", keep=True))
    return (first.where(wanted).drop(wanted) if wanted else first).withColumnRenamed("user_id", user)


def global_newest(articles: DataFrame, k: int) -> DataFrame:
    """The newest ``k`` articles of all with their rank: k rows, ordered once."""
    top = articles.select("article_id", "published_at").orderBy(F.desc("published_at"), F.asc("article_id")).limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("published_at"), F.asc("article_id"))))


def scoped_newest(users: DataFrame, scoped_users: DataFrame, newest: DataFrame, articles: DataFrame, user_stock: DataFrame, k: int) -> DataFrame:
    """Newest ``k`` articles of each user: of the watchlist for ``scoped_users``, of all for the rest.

    Users with one watchlist share one list; the rest share one of k rows, which is broadcast.
    """
    members, sets = watch_sets(user_stock)
    own = user_newest(newest, sets, k, user="set_id").join(members, "set_id").drop("set_id")
    rest = users.select("user_id").join(scoped_users.select("user_id"), "user_id", "left_anti")
    shared = rest.crossJoin(F.broadcast(global_newest(articles, k)))
    return own.unionByName(shared)


def showable(newest: DataFrame, articles: DataFrame, k: int) -> DataFrame:
    """Ids of all articles that can be on a page of ``k``: the newest of a stock, or of all."""
    return newest.select("article_id").unionByName(global_newest(articles, k).select("article_id")).distinct()


def users_with_articles(links: DataFrame, user_stock: DataFrame) -> DataFrame:
    """Users with at least one article in scope, found stock by stock."""
    return user_stock.join(links.select("stock_id").distinct(), "stock_id", "left_semi").select("user_id").distinct()


def users_with_watchlist(user_stock: DataFrame) -> DataFrame:
    return user_stock.select("user_id").distinct()


def article_sets(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(set_id, n), how many articles have just that set of stocks, and (set_id, stock_id). A set is
    named by its least article, and told apart as in ``watch_sets``."""
    own = links.select("article_id", "stock_id").distinct()
    sums = [F.bit_xor(F.xxhash64("stock_id", F.lit(i))).alias(c) for i, c in enumerate(("a", "b"))]
    marked = own.groupBy("article_id").agg(F.count(F.lit(1)).alias("m"), *sums)
    counted = marked.groupBy("m", "a", "b").agg(F.min("article_id").alias("set_id"), F.count(F.lit(1)).alias("n"))
    counted = written(counted.select("set_id", "n"), "article-sets")
    stocks = own.join(counted.select("set_id"), F.col("article_id") == F.col("set_id")).select("set_id", "stock_id")
    return counted, stocks


def articles_24h(users: DataFrame, links: DataFrame, articles: DataFrame, user_stock: DataFrame, as_of: datetime) -> DataFrame:
    """(user_id, articles_24h): articles of the last day in scope.

    Users whose stocks have articles count those, the others count all; that is one number.
    Articles are counted by their set of stocks, and sets meet their followers: a set counts once
    for a user, however many of its stocks the user follows.
    """
    recent = written(in_window(articles.select("article_id", "published_at"), "published_at", as_of, "24h").select("article_id"), "recent")
    counted, stocks = article_sets(written(links.join(recent, "article_id", "left_semi"), "recent-links"))
    met = user_stock.join(stocks, "stock_id").select("user_id", "set_id").distinct()
    own = met.join(counted, "set_id").groupBy("user_id").agg(F.sum("n").alias("own"))
    scoped = users_with_articles(links, user_stock).withColumn("scoped", F.lit(True))
    everything = recent.agg(F.count(F.lit(1)).alias("everything"))
    return (
        users.select("user_id")
        .join(scoped, "user_id", "left")
        .join(own, "user_id", "left")
        .crossJoin(F.broadcast(everything))
        .select("user_id", F.when(F.col("scoped"), F.coalesce("own", F.lit(0))).otherwise(F.col("everything")).cast("long").alias("articles_24h"))
    )


def article_facts(links: DataFrame, stocks: DataFrame, latest: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """(article_id, tickers, score): tickers in order and the strongest latest reading.

    Both come from one aggregate over the links, or those of the articles in ``only``. Strongest
    is the largest absolute score, of equal ones the smallest stock's; without ``latest`` there
    is no score. Articles without a stock are absent.
    """
    rows = links if only is None else links.join(only.select("article_id"), "article_id", "left_semi")
    rows = rows.join(stocks.select("stock_id", "ticker"), "stock_id")
    made = [F.array_sort(F.collect_set("ticker")).alias("tickers")]
    if latest is not None:
        rows = rows.join(latest.select("stock_id", "score"), "stock_id", "left")
        order = F.when(F.col("score").isNotNull(), F.struct(-F.abs("score"), "stock_id"))
        made.append(F.min_by("score", order).alias("score"))
    return rows.groupBy("article_id").agg(*made)
