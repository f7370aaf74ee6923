"""Registered queries over the adapter views, each with SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import gzip
import json
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mood as m
from ..functions import text as tx
from ..functions import time as tm
from ..operators import ingest, maintain, rank, scope, scoring
from ..sources import feeds, landing, seed
from ..sources.adapters import AS_OF_ARTICLES, AS_OF_READINGS, view, with_views
from ..sources.headlines import HeadlineIndex
from ..sources.schemas import NEWS, TABLES
from ..sources.storage import files_in, scratch, scratch_path, shared_path, tidy_shuffles, written
from ..streaming.ingest import read_articles, read_rejects, stream_ingest
from ..streaming.ingest import stream_company_news as take_company_news
from ..streaming.ingest import stream_readings as take_readings
from ..streaming.newest import kept_articles, kept_readings
from . import dashboard as d
from . import pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

A, R = f"TIMESTAMP '{AS_OF_ARTICLES}'", f"TIMESTAMP '{AS_OF_READINGS}'"


def query(sql: str, *views: str):
    """Register a query under its function's name with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql, *views)
        return f

    return add


def tables(spark: SparkSession, sf_dir: str) -> d.Tables:
    v = lambda name: view(spark, sf_dir, name)
    return d.Tables(v("app_user"), v("stock"), v("market"), v("article"), v("article_stock"), v("sentiment"), v("user_stock"), v("user_market"))


def feed_tables(spark: SparkSession, sf_dir: str) -> d.Tables:
    """The same, with follows, links, articles and latest readings written first: they are read several times."""
    t = tables(spark, sf_dir)
    t = replace(t, **{n: written(getattr(t, n), n.replace("_", "-")) for n in ("user_stock", "article_stock", "article")})
    t.latest = written(t.latest, "latest")
    return t


def feed(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    with scratch(spark):
        return longs(d.news_feed(feed_tables(spark, sf_dir), AS_OF_ARTICLES, **how), "rank")


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# ---- SQL fragments --------------------------------------------------------------------------


def label_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} > 0.6 THEN 'Very Bullish' WHEN {c} > 0.2 THEN 'Bullish' WHEN {c} > -0.2 THEN 'Neutral' WHEN {c} > -0.6 THEN 'Bearish' ELSE 'Very Bearish' END"


def bucket_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'none' WHEN {c} > 0.2 THEN 'bull' WHEN {c} < -0.2 THEN 'bear' ELSE 'neutral' END"


LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY date DESC, sentiment_id) AS r FROM sentiment) WHERE r = 1)"
WATCH = f"{LATEST}, watch AS (SELECT u.user_id, s.stock_id, s.ticker, s.market_id, l.score, l.date FROM user_stock u JOIN stock s USING (stock_id) LEFT JOIN latest l USING (stock_id))"
HISTORY = "history AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY date DESC, sentiment_id) AS rank FROM sentiment) WHERE rank <= 30)"
NAMES = "names AS (SELECT article_id, list_sort(list(DISTINCT ticker)) AS tickers FROM article_stock JOIN stock USING (stock_id) GROUP BY article_id)"
TOP = "top AS (SELECT article_id, stock_id, score FROM (SELECT a.article_id, l.stock_id, l.score, row_number() OVER (PARTITION BY a.article_id ORDER BY abs(l.score) DESC, l.stock_id) AS r FROM article_stock a JOIN latest l USING (stock_id)) WHERE r = 1)"


def newest_sql(k: int, articles: str = "article", scoped: str = "SELECT DISTINCT user_id FROM user_stock") -> str:
    """CTEs up to ``newest`` (user_id, article_id, published_at, rank), said plainly: all pairs."""
    return f"""scoped AS ({scoped}),
      own AS (SELECT DISTINCT u.user_id, a.article_id, a.published_at FROM user_stock u JOIN article_stock l USING (stock_id) JOIN {articles} a USING (article_id)),
      mine AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY published_at DESC, article_id) AS rank FROM own) WHERE rank <= {k}),
      everything AS (SELECT * FROM (SELECT article_id, published_at, row_number() OVER (ORDER BY published_at DESC, article_id) AS rank FROM {articles}) WHERE rank <= {k}),
      newest AS (SELECT user_id, article_id, published_at, rank FROM mine UNION ALL
                 SELECT u.user_id, e.article_id, e.published_at, e.rank FROM app_user u, everything e WHERE u.user_id NOT IN (SELECT user_id FROM scoped))"""


WITH_ARTICLES = "SELECT DISTINCT u.user_id FROM user_stock u JOIN article_stock USING (stock_id)"


def age_sql(then: str, now: str) -> str:
    s = f"((epoch_us({now}) - epoch_us({then})) // 1000000)"
    return f"CASE WHEN {s} < 60 THEN 'just now' WHEN {s} < 3600 THEN ({s} // 60) || 'm ago' WHEN {s} < 86400 THEN ({s} // 3600) || 'h ago' ELSE ({s} // 86400) || 'd ago' END"


def feed_sql(k: int, n: int, newest: str, where: str = "true") -> str:
    return f""", {LATEST}, {TOP}, {NAMES}, {newest},
      rows AS (SELECT n.user_id, n.article_id, n.rank AS place, t.score, {bucket_sql('t.score')} AS bucket FROM newest n LEFT JOIN top t USING (article_id)),
      page AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place) AS rank FROM rows WHERE {where})
      SELECT user_id, rank, article_id, score, bucket, coalesce(array_to_string(tickers[1:4], ','), '') AS tickers,
             count(*) OVER (PARTITION BY user_id) >= {n} AS has_more
      FROM page LEFT JOIN names USING (article_id) WHERE rank <= {n}"""


# ---- moods, ages, tickers -------------------------------------------------------------------


@query(f", {WATCH} SELECT u.user_id, round(s, 6) AS score, {label_sql('s')} AS label FROM app_user u LEFT JOIN (SELECT user_id, avg(score) AS s FROM watch GROUP BY user_id) USING (user_id)", "app_user", "stock", "sentiment", "user_stock")
def portfolio_mood(spark, sf_dir):
    return d.portfolio_mood(tables(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("SELECT u.user_id, count(stock_id) AS watchlist_size FROM app_user u LEFT JOIN user_stock USING (user_id) GROUP BY u.user_id", "app_user", "user_stock")
def watchlist_size(spark, sf_dir):
    return d.watchlist_size(tables(spark, sf_dir))


RECENT = f"recent AS (SELECT article_id FROM article WHERE published_at >= {A} - INTERVAL 24 HOURS)"
DAY = f"{RECENT}, counts AS (SELECT u.user_id, count(DISTINCT r.article_id) AS n FROM user_stock u JOIN article_stock USING (stock_id) LEFT JOIN recent r USING (article_id) GROUP BY u.user_id), day AS (SELECT a.user_id, coalesce(c.n, (SELECT count(*) FROM recent)) AS articles_24h FROM app_user a LEFT JOIN counts c USING (user_id))"


@query(f", {DAY} SELECT * FROM day", "app_user", "article", "article_stock", "user_stock")
def articles_24h(spark, sf_dir):
    t = tables(spark, sf_dir)
    return scope.articles_24h(t.users, t.article_stock, t.article, t.user_stock, AS_OF_ARTICLES)


@query(
    f""", {WATCH}, {DAY}, own AS (SELECT user_id, count(*) AS watchlist_size, count(score) AS readings, max(date) AS last_update, avg(score) AS s FROM watch GROUP BY user_id)
    SELECT user_id, coalesce(watchlist_size, 0) AS watchlist_size, articles_24h, coalesce(readings, 0) AS readings, last_update, round(s, 6) AS portfolio_score, {label_sql('s')} AS label
    FROM day LEFT JOIN own USING (user_id)""",
    "app_user", "stock", "sentiment", "article", "article_stock", "user_stock",
)
def overview(spark, sf_dir):
    return d.overview(feed_tables(spark, sf_dir), AS_OF_ARTICLES).withColumn("portfolio_score", F.round("portfolio_score", 6))


@query(
    f""", {WATCH}, scored AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, stock_id) AS up, row_number() OVER (PARTITION BY user_id ORDER BY score, stock_id) AS down FROM watch WHERE score IS NOT NULL)
    SELECT user_id, 'bull' AS side, up AS rank, stock_id, ticker, score, {label_sql('score')} AS label FROM scored WHERE up <= 3
    UNION ALL SELECT user_id, 'bear', down, stock_id, ticker, score, {label_sql('score')} FROM scored WHERE down <= 3""",
    "stock", "sentiment", "user_stock",
)
def top_movers(spark, sf_dir):
    return longs(d.top_movers(tables(spark, sf_dir)), "rank")


@query(
    f""", {NAMES}, {newest_sql(5, scoped=WITH_ARTICLES)}
    SELECT user_id, rank, article_id, headline, coalesce(array_to_string(tickers[1:3], ','), '') AS tickers, {age_sql('n.published_at', A)} AS age
    FROM newest n JOIN article USING (article_id) LEFT JOIN names USING (article_id)""",
    "app_user", "stock", "article", "article_stock", "user_stock",
)
def overview_headlines(spark, sf_dir):
    return longs(d.overview_headlines(feed_tables(spark, sf_dir), AS_OF_ARTICLES), "rank")


FEED_VIEWS = ("app_user", "stock", "sentiment", "article", "article_stock", "user_stock")


@query(feed_sql(50, 50, newest_sql(50)), *FEED_VIEWS)
def news_feed(spark, sf_dir):
    return feed(spark, sf_dir)


@query(feed_sql(200, 50, newest_sql(200), "bucket = 'bull'"), *FEED_VIEWS)
def news_feed_mood(spark, sf_dir):
    return feed(spark, sf_dir, mood="bull")


FOUND = f"found AS (SELECT * FROM article WHERE published_at >= {A} - INTERVAL 720 HOURS AND contains(lower(headline), 'building order 1'))"


@query(feed_sql(50, 50, f"{FOUND}, {newest_sql(50, 'found')}"), *FEED_VIEWS)
def news_feed_search(spark, sf_dir):
    return feed(spark, sf_dir, window="30d", query=" Building Order 1")


#: One of two characters, one that nothing has, common and rare ones.
SEARCHED = ("77", "building order 1", "Order 2", "no such words", "5-LOW FURN", "ship order 999")


@query(
    f"SELECT q AS query, article_id FROM article, (SELECT unnest([{', '.join(repr(x) for x in SEARCHED)}]) AS q) WHERE contains(lower(headline), lower(q))", "article"
)
def search_headlines(spark, sf_dir):
    """Every headline indexed by its pieces, and what a few texts find."""
    index = HeadlineIndex(spark, shared_path(spark, "headline-index")).build(view(spark, sf_dir, "article"))
    found = [index.find(x).select(F.lit(x).alias("query"), "article_id") for x in SEARCHED]
    for more in found[1:]:
        found[0] = found[0].unionByName(more)
    return found[0]


@query(f", {WATCH} SELECT user_id, stock_id, ticker, score, date FROM watch", "stock", "sentiment", "user_stock")
def watch_latest(spark, sf_dir):
    """Watched stocks with their latest readings, from tables in buckets of stock: nothing is shuffled."""
    t = d.bucketed_by_stock(tables(spark, sf_dir), 8)
    return d.watch_latest(t).select("user_id", "stock_id", "ticker", "score", "date")


TICKER = "Supplier#000000007"
NAMED = f"named AS (SELECT * FROM article WHERE article_id IN (SELECT article_id FROM article_stock JOIN stock USING (stock_id) WHERE ticker = '{TICKER}'))"
NAMED_NEWEST = "newest AS (SELECT u.user_id, e.article_id, e.published_at, e.rank FROM app_user u, (SELECT * FROM (SELECT article_id, published_at, row_number() OVER (ORDER BY published_at DESC, article_id) AS rank FROM named) WHERE rank <= 50) e)"


@query(feed_sql(50, 50, f"{NAMED}, {NAMED_NEWEST}"), *FEED_VIEWS)
def news_feed_ticker(spark, sf_dir):
    return longs(d.news_feed(feed_tables(spark, sf_dir), AS_OF_ARTICLES, ticker=TICKER), "rank")


@query(f"SELECT user_id, count(*) AS shown, bool_or(has_more) AS has_more FROM (WITH x AS (SELECT 1) {feed_sql(50, 50, newest_sql(50))}) GROUP BY user_id", *FEED_VIEWS)
def feed_summary(spark, sf_dir):
    return d.feed_summary(d.news_feed(feed_tables(spark, sf_dir), AS_OF_ARTICLES))


@query(
    f""", {LATEST}, {HISTORY}, h AS (SELECT stock_id, count(*) AS n_readings, min(date) AS first_reading FROM history GROUP BY stock_id),
    a AS (SELECT stock_id, least(count(*), 20) AS n_articles FROM article_stock GROUP BY stock_id)
    SELECT s.stock_id, s.ticker, m.name AS market, l.score, {label_sql('l.score')} AS label, coalesce(n_readings, 0) AS n_readings, coalesce(n_articles, 0) AS n_articles, first_reading
    FROM stock s JOIN market m USING (market_id) LEFT JOIN latest l USING (stock_id) LEFT JOIN h USING (stock_id) LEFT JOIN a USING (stock_id)""",
    "stock", "market", "sentiment", "article_stock",
)
def stock_detail(spark, sf_dir):
    return d.stock_detail(tables(spark, sf_dir))


@query(
    f""", {LATEST} SELECT x.stock_id, rank, article_id, published_at, {bucket_sql('l.score')} AS badge
    FROM (SELECT stock_id, article_id, published_at, row_number() OVER (PARTITION BY stock_id ORDER BY published_at DESC, article_id) AS rank FROM article_stock JOIN article USING (article_id)) x
    LEFT JOIN latest l USING (stock_id) WHERE rank <= 20""",
    "sentiment", "article", "article_stock",
)
def stock_articles(spark, sf_dir):
    return longs(d.stock_articles(tables(spark, sf_dir)), "rank")


@query(
    f""", {HISTORY} SELECT stock_id, row_number() OVER (PARTITION BY stock_id ORDER BY rank DESC) AS pos, sentiment_id, date, strftime(date, '%b %-d') AS day, score, round(score, 3) + 0.0 AS score_3 FROM history""",
    "sentiment",
)
def stock_history(spark, sf_dir):
    return longs(d.stock_history(tables(spark, sf_dir)), "pos")


@query(
    f""", {WATCH}, {HISTORY}, h AS (SELECT stock_id, count(*) AS n FROM history GROUP BY stock_id)
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC NULLS LAST, ticker) AS rank, ticker, coalesce(score, 0.0) AS shown_score,
      {label_sql('coalesce(score, 0.0)')} AS label, coalesce(n, 0) AS readings, coalesce(n, 0) > 1 AS trend FROM watch LEFT JOIN h USING (stock_id)""",
    "stock", "sentiment", "user_stock",
)
def sentiment_board(spark, sf_dir):
    return longs(d.sentiment_board(tables(spark, sf_dir)), "rank")


@query(
    f""", {WATCH} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ticker, stock_id) AS rank, ticker, m.name AS market, score, {bucket_sql('score')} AS bucket,
    CASE WHEN score IS NULL THEN 'No data' ELSE (CASE WHEN score > 0.2 THEN 'up' WHEN score < -0.2 THEN 'down' ELSE 'flat' END) || printf(' %.2f', score) END AS badge FROM watch JOIN market m USING (market_id)""",
    "stock", "market", "sentiment", "user_stock",
)
def watchlist(spark, sf_dir):
    return longs(d.watchlist(tables(spark, sf_dir)), "rank")


@query("SELECT u.user_id, m.market_id, m.name, f.user_id IS NOT NULL AS followed, '📊' AS icon FROM app_user u CROSS JOIN market m LEFT JOIN user_market f ON f.user_id = u.user_id AND f.market_id = m.market_id", "app_user", "market", "user_market")
def markets_board(spark, sf_dir):
    return d.markets_board(tables(spark, sf_dir))


@query(
    """, every AS (SELECT list_sort(list(market_id)) AS e FROM market), own AS (SELECT user_id, list_sort(list(DISTINCT market_id)) AS o FROM user_market GROUP BY user_id)
    SELECT a.user_id, coalesce(array_to_string(o, ','), '') AS followed, array_to_string(list_filter(e, lambda x: NOT list_contains(coalesce(o, []), x)), ',') AS others
    FROM app_user a LEFT JOIN own USING (user_id), every""",
    "app_user", "market", "user_market",
)
def market_lists(spark, sf_dir):
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return d.market_lists(tables(spark, sf_dir)).select("user_id", joined("followed"), joined("others"))


@query(f"SELECT max(date) AS last_run, 'Updated ' || {age_sql('max(date)', R)} AS label FROM sentiment", "sentiment")
def pipeline_status(spark, sf_dir):
    return d.pipeline_status(tables(spark, sf_dir), AS_OF_READINGS)


@query(f", {LATEST} SELECT stock_id, sentiment_id, score, date FROM latest", "sentiment")
def latest_sentiment(spark, sf_dir):
    return rank.latest_sentiment(view(spark, sf_dir, "sentiment"))


@query(f", {LATEST}, {TOP} SELECT * FROM top", "sentiment", "article_stock")
def top_sentiment(spark, sf_dir):
    t = tables(spark, sf_dir)
    return rank.top_sentiment(t.article_stock, t.latest)


@query(f"SELECT {bucket_sql('score')} AS bucket, {label_sql('score')} AS label, count(*) AS n FROM sentiment GROUP BY ALL", "sentiment")
def mood_distribution(spark, sf_dir):
    s = F.col("score")
    return view(spark, sf_dir, "sentiment").groupBy(m.mood_bucket(s).alias("bucket"), m.mood(s)["label"].alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT sentiment_id, {age_sql('date', R)} AS age FROM sentiment", "sentiment")
def relative_age(spark, sf_dir):
    df = view(spark, sf_dir, "sentiment")
    return df.select("sentiment_id", tm.relative_age(F.col("date"), tm.as_of_like(df, "date", AS_OF_READINGS)).alias("age"))


CANDIDATES = """CASE WHEN ticker LIKE '%.LS' THEN ['EURONEXT_LISBON'] WHEN ticker LIKE '%.L' THEN ['LSE'] WHEN ticker LIKE '%.PA' THEN ['EURONEXT_PARIS'] WHEN ticker LIKE '%.DE' THEN ['XETRA']
    WHEN ticker LIKE '%.AS' THEN ['EURONEXT_AMSTERDAM'] WHEN ticker LIKE '%-USD' THEN ['CRYPTO'] ELSE ['NYSE', 'NASDAQ'] END"""


@query(f"SELECT stock_id, ticker, array_to_string({CANDIDATES}, ',') AS candidates FROM listing", "listing")
def market_candidates(spark, sf_dir):
    return view(spark, sf_dir, "listing").select("stock_id", "ticker", F.array_join(tx.market_candidates(F.col("ticker")), ",").alias("candidates"))


@query("SELECT stock_id, ticker, CASE WHEN ticker LIKE '%.%' THEN 'tagged' WHEN ticker LIKE '%-USD' THEN 'none' ELSE 'primary' END AS feed FROM listing", "listing")
def route_feed(spark, sf_dir):
    return view(spark, sf_dir, "listing").select("stock_id", "ticker", tx.route_feed(F.col("ticker")).alias("feed"))


@query("SELECT stock_id, ticker, market_id, 'primary' AS feed FROM stock WHERE stock_id IN (SELECT stock_id FROM user_stock)", "stock", "user_stock")
def watched_stocks(spark, sf_dir):
    t = tables(spark, sf_dir)
    return scope.watched_stocks(t.stock, t.user_stock)


# ---- ingest ----------------------------------------------------------------------------------

NEW_PAGES = """, stored AS (SELECT url FROM page_news WHERE pos % 4 = 0), fresh AS (SELECT url, headline, source FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos) AS r FROM page_news
    WHERE pos % 4 <> 0 AND length(url) > 0 AND length(headline) > 0) WHERE r = 1 AND url NOT IN (SELECT url FROM stored))"""


def _new_pages(spark, sf_dir):
    pages = view(spark, sf_dir, "page_news")
    batch = ingest.valid_articles(pages.where("pos % 4 <> 0")).select("url", "headline", "source", "pos")
    return ingest.insert_new_articles(pages.where("pos % 4 = 0").select("url"), batch, ("pos",))


@query(f"{NEW_PAGES} SELECT url, headline, source, sha256(url) AS article_id FROM fresh", "page_news")
def insert_new_articles(spark, sf_dir):
    return _new_pages(spark, sf_dir)


@query("SELECT DISTINCT l_orderkey AS article_id, l_suppkey AS stock_id FROM lineitem WHERE l_orderkey % 4 <> 0", "market")
def insert_new_links(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("article_id"), F.col("l_suppkey").alias("stock_id"))
    return ingest.insert_new_links(rows.where("article_id % 4 = 0"), rows)


@query("SELECT article_id, stock_id FROM tagged_event JOIN stock ON k = stock_id", "tagged_event", "stock")
def link_entities(spark, sf_dir):
    events = view(spark, sf_dir, "tagged_event")
    url = F.col("article_id").cast("string").alias("url")
    tagged = events.select(url, F.array(F.struct(F.col("k").cast("string").alias("symbol"))).alias("entities"))
    stocks = view(spark, sf_dir, "stock").select(F.col("stock_id").cast("string").alias("ticker"), "stock_id")
    return ingest.link_entities(tagged, stocks, events.select(url, "article_id"))


HEADLINES = f"""heads AS (SELECT * FROM (SELECT stock_id, ticker, article_id, headline, row_number() OVER (PARTITION BY stock_id ORDER BY published_at DESC, article_id) AS rank
    FROM article_stock JOIN stock USING (stock_id) JOIN article USING (article_id) WHERE published_at >= {A} - INTERVAL 168 HOURS AND stock_id IN (SELECT stock_id FROM user_stock)) WHERE rank <= 10)"""


def _headlines(spark, sf_dir):
    t = tables(spark, sf_dir)
    return scoring.recent_headlines(t.article_stock, t.article, scope.watched_stocks(t.stock, t.user_stock), AS_OF_ARTICLES)


@query(f", {HEADLINES} SELECT stock_id, rank, article_id, headline FROM heads", "stock", "article", "article_stock", "user_stock")
def recent_headlines(spark, sf_dir):
    return longs(_headlines(spark, sf_dir), "rank").select("stock_id", "rank", "article_id", "headline")


@query(f", {HEADLINES} SELECT stock_id, string_agg(rank || '. ' || headline, chr(10) ORDER BY rank) AS headlines FROM heads GROUP BY stock_id", "stock", "article", "article_stock", "user_stock")
def prompts(spark, sf_dir):
    built = scoring.build_prompts(_headlines(spark, sf_dir))
    return built.select("stock_id", F.substring_index("prompt", "\n\n", -1).alias("headlines"))


@query("SELECT stock_id, CASE WHEN stock_id % 5 = 0 THEN CAST(0.4 AS DOUBLE) END AS score, CASE WHEN stock_id % 5 = 0 THEN event_type END AS summary FROM raw_answer JOIN events ON event_id = stock_id", "raw_answer")
def parse_scores(spark, sf_dir):
    raw = view(spark, sf_dir, "raw_answer")
    ok, rejects = scoring.parse_scores(raw)
    lost = rejects.select(F.col("key").cast("long").alias("stock_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("summary"))
    return ok.unionByName(lost)


@query("SELECT * EXCLUDE (r) FROM (SELECT pos, url, headline, source, row_number() OVER (PARTITION BY url ORDER BY pos) AS r FROM page_news) WHERE r = 1", "page_news")
def dedupe_first(spark, sf_dir):
    return rank.dedupe_first(view(spark, sf_dir, "page_news").drop("there"), ["url"], ["pos"])


@query("SELECT * EXCLUDE (r) FROM (SELECT pos, url, headline, source, row_number() OVER (PARTITION BY url ORDER BY pos DESC) AS r FROM page_news) WHERE r = 1", "page_news")
def dedupe_last(spark, sf_dir):
    return rank.dedupe_last(view(spark, sf_dir, "page_news").drop("there"), ["url"], ["pos"])


# ---- maintenance -----------------------------------------------------------------------------

HITS = """hits AS (SELECT p_brand AS query, p_name AS symbol, p_partkey AS pos, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS r FROM part WHERE p_type = 'ECONOMY' AND length(p_name) > 0) WHERE r = 1 QUALIFY rank <= 10)"""


def _hits(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_brand").alias("query"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("symbol"), F.col("p_name").alias("description"), F.col("p_type").alias("type")
    )
    return maintain.search_stocks(parts, "ECONOMY")


@query(f", {HITS} SELECT query, symbol, pos, rank FROM hits", "market")
def search_stocks(spark, sf_dir):
    return longs(_hits(spark, sf_dir), "rank").select("query", "symbol", "pos", "rank")


INFERRED = f"""pick AS (SELECT l.stock_id, l.ticker, (SELECT min(market_id) FROM exchange WHERE name = c[1]) AS one, (SELECT min(market_id) FROM exchange WHERE name = c[2]) AS two
    FROM (SELECT *, {CANDIDATES} AS c FROM listing) l), inferred AS (SELECT stock_id, ticker, coalesce(one, two, (SELECT arg_min(market_id, name) FROM exchange)) AS market_id FROM pick)"""


@query(f", {INFERRED} SELECT * FROM inferred", "listing", "exchange")
def infer_market(spark, sf_dir):
    return maintain.infer_market(view(spark, sf_dir, "listing"), view(spark, sf_dir, "exchange")).select("stock_id", "ticker", "market_id")


@query(
    f""", {INFERRED} SELECT s.stock_id, s.ticker, CASE WHEN s.stock_id % 3 = 0 THEN 'New ' || s.name ELSE s.name END AS name,
    CASE WHEN s.stock_id % 3 = 0 THEN i.market_id ELSE -1 END AS market_id FROM listing s JOIN inferred i USING (stock_id)""",
    "listing", "exchange",
)
def upsert_stocks(spark, sf_dir):
    stocks, markets = view(spark, sf_dir, "listing"), view(spark, sf_dir, "exchange")
    # every sixth stock is new, the other multiples of three change; each comes twice, the second counts
    existing = stocks.where("stock_id % 6 <> 0").withColumn("market_id", F.lit(-1))
    batch = stocks.where("stock_id % 3 = 0").withColumn("pos", F.explode(F.array(F.lit(1), F.lit(2))))
    batch = batch.withColumn("name", F.concat(F.when(F.col("pos") == 1, "Older ").otherwise("New "), "name"))
    return maintain.upsert_stocks(existing, maintain.infer_market(batch, markets), ["pos"])


LOG = """, log AS (SELECT user_id, k, arg_max(event_type = 'error', article_id) AS gone FROM tagged_event WHERE article_id % 3 <> 0 GROUP BY ALL),
    state AS (SELECT DISTINCT user_id, k FROM tagged_event WHERE article_id % 3 = 0)
    SELECT user_id, k FROM log WHERE NOT gone UNION SELECT user_id, k FROM state WHERE (user_id, k) NOT IN (SELECT (user_id, k) FROM log WHERE gone)"""


@query(LOG, "tagged_event")
def apply_follow_log(spark, sf_dir):
    events = view(spark, sf_dir, "tagged_event")
    log = events.where("article_id % 3 <> 0").select("user_id", "k", F.when(F.col("event_type") == "error", "DELETE").otherwise("ADD").alias("op"), F.col("article_id").alias("seq"))
    return maintain.apply_follow_log(events.where("article_id % 3 = 0").select("user_id", "k"), log, ("user_id", "k"))


CASCADE = " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n} WHERE stock_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 3)" for n in ("stock", "article_stock", "sentiment", "user_stock"))


@query(CASCADE, "stock", "article_stock", "sentiment", "user_stock")
def cascade_delete(spark, sf_dir):
    own = {n: view(spark, sf_dir, n) for n in ("stock", "article_stock", "sentiment", "user_stock")}
    left = maintain.cascade_delete(own, "stock", own["stock"].where("stock_id % 10 = 3"))
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n, df in left.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    """SELECT i.invitation_id, i.email, CASE WHEN accepted_at IS NULL THEN 'pending' ELSE 'accepted' END AS status, w.email AS invited_by, b.email AS accepted_by, accepted_at, created_at
    FROM invitation i JOIN account w ON w.user_id = i.invited_by_id LEFT JOIN account b ON b.user_id = i.accepted_by_user_id""",
    "invitation", "account",
)
def invitations_view(spark, sf_dir):
    return maintain.invitations_view(view(spark, sf_dir, "invitation"), view(spark, sf_dir, "account"))


@query("SELECT CASE WHEN accepted_at IS NULL THEN 'pending' ELSE 'accepted' END AS status, count(*) AS n FROM invitation GROUP BY ALL", "invitation")
def invitation_counts(spark, sf_dir):
    return view(spark, sf_dir, "invitation").groupBy(maintain.invitation_status(F.col("accepted_at")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(
    r""", asked AS (SELECT request_id, trim(lower(email)) AS email FROM invite_request)
    SELECT request_id, email, CASE WHEN NOT regexp_matches(email, '^[^\s@]+@[^\s@]+\.[^\s@]+$') THEN 'invalid' WHEN email IN (SELECT email FROM account WHERE email IS NOT NULL) THEN 'user_exists'
      WHEN email IN (SELECT email FROM invitation WHERE accepted_at IS NOT NULL) THEN 'already_accepted' WHEN email IN (SELECT email FROM invitation) THEN 'already_invited'
      WHEN request_id <> min(request_id) OVER (PARTITION BY email) THEN 'already_invited' ELSE 'ok' END AS outcome FROM asked""",
    "invite_request", "account", "invitation",
)
def classify_invites(spark, sf_dir):
    return maintain.classify_invites(view(spark, sf_dir, "invite_request"), view(spark, sf_dir, "account"), view(spark, sf_dir, "invitation"))


@query(
    """, asked AS (SELECT external_id, trim(lower(email)) AS email, external_id IN (SELECT external_id FROM account) AS known FROM signup),
    claim AS (SELECT a.*, i.invitation_id, min(CASE WHEN NOT known THEN external_id END) OVER (PARTITION BY i.invitation_id) AS winner FROM asked a
      LEFT JOIN (SELECT * FROM invitation WHERE accepted_at IS NULL) i ON i.email = a.email)
    SELECT external_id, email, CASE WHEN known THEN 'known' WHEN invitation_id IS NOT NULL AND winner = external_id THEN 'created' ELSE 'blocked' END AS outcome,
      CASE WHEN NOT known AND invitation_id IS NOT NULL AND winner = external_id THEN invitation_id END AS invitation_id FROM claim""",
    "signup", "account", "invitation",
)
def admit_signups(spark, sf_dir):
    return maintain.admit_signups(view(spark, sf_dir, "signup"), view(spark, sf_dir, "account"), view(spark, sf_dir, "invitation"))


@query("SELECT user_id, external_id, coalesce(a.email, trim(lower(i.email))) AS email FROM account a LEFT JOIN identity i USING (external_id)", "account", "identity")
def backfill_emails(spark, sf_dir):
    return maintain.backfill_emails(view(spark, sf_dir, "account"), view(spark, sf_dir, "identity"))


@query(
    """SELECT o_orderkey * 2 AS invitation_id, CASE WHEN i.invitation_id IS NULL THEN 'not_found' WHEN accepted_at IS NOT NULL THEN 'accepted' ELSE 'revoked' END AS outcome
    FROM orders LEFT JOIN invitation i ON invitation_id = o_orderkey * 2""",
    "invitation",
)
def revocable(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") * 2).alias("invitation_id"))
    return maintain.revocable(view(spark, sf_dir, "invitation"), ids)


LANDED = """, landed AS (SELECT event_id // 3 AS g, CASE WHEN event_type = 'error' THEN '' ELSE 'item' END AS h, CASE WHEN event_id % 7 <> 3 THEN 'events' END AS source FROM events)
    SELECT 'article' AS kind, 'https://e.example.com/' || g AS key, 'item ' || g AS value, TIMESTAMP '2024-01-01' + to_minutes(CAST(g AS INTEGER)) AS published_at
    FROM landed WHERE h <> '' AND source IS NOT NULL GROUP BY g
    UNION ALL SELECT 'reject', 'general: url or headline is missing', CAST(count(*) AS VARCHAR), NULL FROM landed WHERE h = ''
    UNION ALL SELECT 'reject', 'store: a required field is null', CAST(count(*) AS VARCHAR), NULL FROM landed WHERE h <> '' AND source IS NULL
    UNION ALL SELECT 'reject', 'general: no JSON', CAST(count(*) AS VARCHAR), NULL FROM region"""


@query(LANDED, "tagged_event")
def stream_ingest_events(spark, sf_dir):
    """Events landed as JSON files by day, lines that are no JSON among them, taken in by a stream
    that stops at the end: the articles and the rejects by stage and message."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    feed, store, marks = (shared_path(spark, n) for n in ("feed", "articles", "stream"))
    number = F.expr("event_id div 3")
    events.select(
        F.to_date("ts").alias("day"), F.lit("general").alias("category"), (F.unix_seconds(F.lit(datetime(2024, 1, 1)).cast("timestamp")) + number * 60).alias("datetime"),
        F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit("item "), number.cast("string"))).alias("headline"), F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 7 != 3, "events").alias("source"), F.concat(F.lit("https://e.example.com/"), number.cast("string")).alias("url"),
    ).write.partitionBy("day").json(feed)
    spark.read.parquet(f"{sf_dir}/region.parquet").select(F.concat(F.lit('{"url": "'), "r_name")).coalesce(1).write.text(f"{feed}/day=broken")
    stream_ingest(spark, f"{feed}/day=*", store, marks, files_per_batch=10)
    rejects = read_rejects(spark, store).groupBy(F.concat_ws(": ", "stage", "message").alias("key")).agg(F.count(F.lit(1)).cast("string").alias("value"))
    found = read_articles(spark, store).select(F.lit("article").alias("kind"), F.col("url").alias("key"), F.col("headline").alias("value"), F.col("published_at").cast("timestamp_ntz").alias("published_at"))
    return found.unionByName(rejects.select(F.lit("reject").alias("kind"), "key", "value", F.lit(None).cast("timestamp_ntz").alias("published_at")))


@query(f", {HISTORY} SELECT stock_id, rank, sentiment_id, score, date FROM history", "sentiment")
def stream_readings(spark, sf_dir):
    """Readings landed in files in the order of a hash, so that old ones come late: the last thirty
    of each stock are kept batch by batch."""
    feed, marks, at = (shared_path(spark, n) for n in ("readings", "stream", "kept"))
    readings = view(spark, sf_dir, "sentiment").withColumn("date", F.col("date").cast("timestamp"))
    readings.repartition(5, F.xxhash64("sentiment_id")).write.parquet(feed)
    kept = kept_readings(spark, at, key="long")
    take_readings(spark, feed, marks, kept, files_per_batch=1)
    return longs(kept.read(), "rank").select("stock_id", "rank", "sentiment_id", "score", F.col("date").cast("timestamp_ntz").alias("date"))


@query(
    """, linked AS (SELECT DISTINCT l.stock_id, sha256(a.url) AS article_id, a.published_at FROM article_stock l JOIN article a USING (article_id))
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY published_at DESC, article_id) AS rank FROM linked) WHERE rank <= 20""",
    "article", "article_stock",
)
def stream_company_news(spark, sf_dir):
    """Company news of every link in the order of a hash: the newest twenty articles of each stock."""
    t = tables(spark, sf_dir)
    feed, table, marks, at = (shared_path(spark, n) for n in ("company", "articles", "stream", "kept"))
    seconds = F.unix_seconds(F.col("published_at").cast("timestamp")).alias("datetime")
    with scratch(spark):
        links = written(t.article_stock, "article-stock").withColumn("ticker", F.col("stock_id").cast("string"))
        news = written(links.join(t.article, "article_id").select("url", "headline", "source", seconds, "ticker"), "news")
        for i in range(4):  # a quarter after the other, each in files that tasks can share
            quarter = news.where(F.pmod(F.xxhash64("url", "ticker"), F.lit(4)) == i).write.mode("append")
            quarter.option("maxRecordsPerFile", 1 << 18).option("compression", "gzip").json(feed)
    newest = kept_articles(spark, at, key="long")
    stocks = t.stock.select("stock_id", F.col("stock_id").cast("string").alias("ticker"))
    take_company_news(spark, feed, table, marks, stocks, newest, files_per_batch=-(-len(files_in(spark, feed)) // 4))
    return longs(newest.read(), "rank").select("stock_id", "rank", "article_id", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


# ---- readers, the full run, and what only it had called ---------------------------------------


def _land_news(feed: DataFrame, path: str, *folders: str) -> str:
    """A feed as JSON files in the order of ``seq``."""
    rows = feed.withColumn("datetime", F.unix_seconds(F.col("published_at").cast("timestamp"))).drop("published_at")
    return _land(rows.orderBy("seq", "datetime", "headline", "source").drop("seq"), path, *folders)


def _land(rows: DataFrame, path: str, *folders: str) -> str:
    """Rows in their order as packed JSON files, each small enough for a task to hold."""
    out = rows.write.option("compression", "gzip").option("maxRecordsPerFile", 1 << 18)
    with tidy_shuffles(rows.sparkSession):
        (out.partitionBy(*folders) if folders else out).json(path)
    return path


def _land_tagged(feed: DataFrame, path: str) -> str:
    """Responses with an article each, in the order of ``seq``."""
    symbols = F.array(*[F.struct(F.col(c).alias("symbol")) for c in ("first_symbol", "second_symbol")])
    article = F.struct(
        F.col("seq").cast("string").alias("uuid"), "title", "url", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("published_at"),
        F.lit("events").alias("source"), symbols.alias("entities"),
    )
    asked = [c for c in ("batch",) if c in feed.columns]
    return _land(feed.orderBy("seq").select(F.array(article).alias("data"), *asked), path)


def _put(spark: SparkSession, path: str, content: bytes) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(content))
    out.close()


@query("SELECT url, headline, source, published_at FROM general_feed", "general_feed")
def read_market_news(spark, sf_dir):
    path = _land_news(view(spark, sf_dir, "general_feed").withColumn("category", F.lit("general")), shared_path(spark, "market-news"), "category")
    return ingest.normalize_news(feeds.read_market_news(spark, path)).select("url", "headline", "source", "published_at")


@query("SELECT 'N' || s_nationkey AS ticker, url, headline, date_trunc('year', published_at) AS dt FROM company_feed JOIN listing USING (ticker) JOIN supplier ON s_suppkey = stock_id WHERE published_at >= TIMESTAMP '1996-01-01' AND published_at < TIMESTAMP '1999-01-01'", "company_feed", "listing")
def read_company_news(spark, sf_dir):
    """Company news by nation and year of three years; other folders are not opened."""
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("stock_id"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("nation"))
    news = view(spark, sf_dir, "company_feed").join(view(spark, sf_dir, "listing").select("ticker", "stock_id"), "ticker").join(suppliers, "stock_id")
    news = news.withColumn("ticker", F.col("nation")).withColumn("dt", F.to_date(F.date_trunc("year", "published_at"))).drop("nation", "stock_id")
    path = _land_news(news, shared_path(spark, "company-news"), "ticker", "dt")
    return feeds.read_company_news(spark, path, "1996-01-01", "1998-12-31").select("ticker", "url", "headline", F.col("dt").cast("timestamp_ntz").alias("dt"))


@query("SELECT url, title AS headline, published_at, first_symbol || ',' || second_symbol AS symbols FROM tagged_feed WHERE published_at >= TIMESTAMP '2024-01-15 12:30:00'", "tagged_feed")
def read_tagged_news(spark, sf_dir):
    path = _land_tagged(view(spark, sf_dir, "tagged_feed"), shared_path(spark, "tagged-news"))
    rows = ingest.normalize_tagged(feeds.read_tagged_news(spark, path, datetime(2024, 1, 15, 12, 30, 59)))
    return rows.select("url", "headline", "published_at", F.array_join("entities.symbol", ",").alias("symbols"))


@query("SELECT p_name AS symbol, p_type AS type, p_brand AS description, row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) - 1 AS pos FROM part", "market")
def read_symbol_search(spark, sf_dir):
    """Search responses of fifty hits each, exploded in order."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    hit = F.struct("p_partkey", F.col("p_brand").alias("description"), F.col("p_name").alias("symbol"), F.col("p_type").alias("type"))
    path = shared_path(spark, "symbols")
    parts.groupBy(F.expr("p_partkey div 50")).agg(F.sort_array(F.collect_list(hit)).alias("result")).select("result").write.json(path)
    return longs(feeds.read_symbol_search(spark, path), "pos").select("symbol", "type", "description", "pos")


RUN = f""", watched AS (SELECT * FROM listing WHERE stock_id IN (SELECT stock_id FROM user_stock)),
    prime AS (SELECT * FROM watched WHERE ticker NOT LIKE '%.%' AND ticker NOT LIKE '%-USD'), dotted AS (SELECT *, (row_number() OVER (ORDER BY ticker, stock_id) - 1) // 5 AS batch FROM watched WHERE ticker LIKE '%.%'),
    company AS (SELECT * FROM company_feed WHERE ticker IN (SELECT ticker FROM prime)),
    brought AS (SELECT 0 AS feed, seq, url, headline, source, published_at FROM general_feed UNION ALL SELECT 1, seq, url, headline, source, published_at FROM company
      UNION ALL SELECT 2, seq, url, title, 'events', published_at FROM tagged_feed),
    good AS (SELECT * FROM brought WHERE headline <> ''),
    fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY feed, seq, published_at, headline, source) AS r FROM good WHERE source IS NOT NULL)
      WHERE r = 1 AND url NOT IN (SELECT url FROM stored_article)),
    ids AS (SELECT url, article_id, headline, published_at FROM stored_article UNION ALL SELECT url, sha256(url), headline, published_at FROM fresh),
    tried AS (SELECT i.article_id, p.stock_id FROM (SELECT DISTINCT ticker, url FROM company WHERE headline <> '') c JOIN prime p USING (ticker) JOIN ids i USING (url)
      UNION ALL SELECT i.article_id, d.stock_id FROM (SELECT url, a.batch, unnest([first_symbol, second_symbol]) AS ticker FROM tagged_feed JOIN dotted a ON a.ticker = first_symbol WHERE title <> '') t
        JOIN dotted d ON d.ticker = t.ticker AND d.batch = t.batch JOIN ids i USING (url)),
    linked AS (SELECT DISTINCT article_id, stock_id FROM tried EXCEPT SELECT article_id, stock_id FROM stored_link),
    heads AS (SELECT * FROM (SELECT stock_id, headline, row_number() OVER (PARTITION BY stock_id ORDER BY published_at DESC, article_id) AS r
      FROM (SELECT * FROM linked UNION ALL SELECT article_id, stock_id FROM stored_link) JOIN watched USING (stock_id) JOIN ids USING (article_id)
      WHERE published_at >= {A} - INTERVAL 168 HOURS) WHERE r <= 10),
    words AS (SELECT stock_id, unnest(list_prepend('', string_split_regex(lower(headline), '[^a-z]+'))) AS w FROM heads),
    judged AS (SELECT stock_id, count(*) FILTER (w IN ({', '.join(repr(w) for w in scoring.UP)})) AS u, count(*) FILTER (w IN ({', '.join(repr(w) for w in scoring.DOWN)})) AS d FROM words GROUP BY stock_id)
    SELECT 'article' AS kind, sha256(url) AS key, url || '|' || headline || '|' || source AS value FROM fresh
    UNION ALL SELECT 'link', article_id, CAST(stock_id AS VARCHAR) FROM linked
    UNION ALL SELECT 'reading', CAST(stock_id AS VARCHAR), CAST(CAST(round(1000 * CASE WHEN u + d > 0 THEN (u - d) / (u + d) ELSE 0 END) AS BIGINT) AS VARCHAR) FROM judged
    UNION ALL SELECT 'reject', CASE feed WHEN 0 THEN 'general: url or headline is missing' WHEN 1 THEN 'company: url or headline is missing' ELSE 'tagged: url or title is missing' END, CAST(count(*) AS VARCHAR) FROM brought WHERE headline = '' GROUP BY feed
    UNION ALL SELECT 'reject', 'store: a required field is null', CAST(count(*) AS VARCHAR) FROM good WHERE source IS NULL
    UNION ALL SELECT 'reject', 'company: HTTP 429', CAST(count(*) AS VARCHAR) FROM supplier
    UNION ALL SELECT 'reject', 'tagged: HTTP 402 ' || r_name, '1' FROM region
    UNION ALL SELECT 'reject', 'general: no JSON', CAST(count(*) AS VARCHAR) FROM nation
    UNION ALL SELECT 'reject', 'general: the file is cut short', '1'
    UNION ALL SELECT 'report', 'fetched', CAST(count(*) AS VARCHAR) FROM brought UNION ALL SELECT 'report', 'saved', CAST(count(*) AS VARCHAR) FROM fresh
    UNION ALL SELECT 'report', 'tags', CAST(count(*) AS VARCHAR) FROM tried UNION ALL SELECT 'report', 'new_links', CAST(count(*) AS VARCHAR) FROM linked
    UNION ALL SELECT 'report', 'sentiments', CAST(count(*) AS VARCHAR) FROM judged"""


@query(RUN, "listing", "user_stock", "general_feed", "company_feed", "tagged_feed", "stored_article", "stored_link")
def run_pipeline(spark, sf_dir):
    """The full run over landed feeds, with failed requests, torn lines and a cut file among them: rows
    for each table, rejects by stage and message, and the report."""
    v = lambda name: view(spark, sf_dir, name)
    raw = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    own = {"stock": v("listing"), "user_stock": v("user_stock"), "article": v("stored_article"), "article_stock": v("stored_link")}
    with scratch(spark):  # of the run
        with scratch(spark):  # of the feeds' files
            general = _land_news(v("general_feed").withColumn("category", F.lit("general")), scratch_path(spark, "general"))
            raw("nation").select(F.concat(F.lit('{"headline": "'), "n_name")).coalesce(1).write.mode("append").text(general)
            _put(spark, f"{general}/cut.json.gz", gzip.compress(json.dumps({"category": "general", "url": "lost", "headline": "lost"}).encode())[:-9])
            company = _land_news(v("company_feed"), scratch_path(spark, "company"))
            raw("supplier").select(F.col("s_name").alias("ticker"), F.lit("HTTP 429").alias("error")).write.mode("append").json(company)
            # each article answers the request that asked for its first symbol
            dotted = scope.watched_stocks(own["stock"], own["user_stock"]).where("feed = 'tagged'")
            asked = ingest.request_batches(dotted).select(F.col("ticker").alias("first_symbol"), "batch")
            tagged = _land_tagged(v("tagged_feed").join(asked, "first_symbol", "left"), scratch_path(spark, "tagged"))
            raw("region").select(F.col("r_regionkey").alias("batch"), F.concat(F.lit("HTTP 402 "), "r_name").alias("error")).write.mode("append").json(tagged)
            landed = landing.land_general(spark, general), landing.land_company(spark, company), landing.land_tagged(spark, tagged)
        got = pipeline.run_pipeline(own, *landed, AS_OF_ARTICLES)
    text = lambda c: F.col(c).cast("string")
    row = lambda df, kind, key, value: df.select(F.lit(kind).alias("kind"), key.alias("key"), value.alias("value"))
    names = ("fetched", "saved", "tags", "new_links", "sentiments")
    counted = got.report.select(F.explode(F.array(*[F.struct(F.lit(n).alias("n"), text(n).alias("v")) for n in names])).alias("x")).select("x.*")
    return (
        row(got.articles, "article", F.col("article_id"), F.concat_ws("|", "url", "headline", "source"))
        .unionByName(row(got.links, "link", F.col("article_id"), text("stock_id")))
        .unionByName(row(got.readings, "reading", text("stock_id"), F.round(F.col("score") * 1000).cast("long").cast("string")))
        .unionByName(row(got.rejects.groupBy(F.concat_ws(": ", "stage", "message").alias("why")).agg(F.count(F.lit(1)).alias("n")), "reject", F.col("why"), text("n")))
        .unionByName(row(counted, "report", F.col("n"), F.col("v")))
    )


@query("SELECT sha256(stock_id || '|2024-01-31 00:00:00') AS sentiment_id, stock_id, CAST(0.4 AS DOUBLE) AS score, event_type AS summary, TIMESTAMP '2024-01-31' AS date FROM raw_answer JOIN events ON event_id = stock_id WHERE stock_id % 5 = 0", "raw_answer")
def append_sentiment(spark, sf_dir):
    ok, _ = scoring.parse_scores(view(spark, sf_dir, "raw_answer"))
    return ingest.append_sentiment(ok, AS_OF_READINGS).select("sentiment_id", "stock_id", "score", "summary", "date")


def _count_lines(prompts: list[str]) -> list[str]:
    """A model for tests: a tenth for each headline, and it refuses to judge nine of them."""
    n = [p.split("\n\n")[-1].count("\n") + 1 for p in prompts]
    if 9 in n:
        raise ValueError("nine headlines")
    return [f'{{"score": {k / 10}, "summary": "{k} headlines"}}' for k in n]


@query(f", {HEADLINES} SELECT stock_id, CASE WHEN n <> 9 THEN n / 10 END AS score, CASE WHEN n = 9 THEN 'nine headlines' ELSE n || ' headlines' END AS said FROM (SELECT stock_id, count(*) AS n FROM heads GROUP BY stock_id)", "stock", "article", "article_stock", "user_stock")
def score(spark, sf_dir):
    """A scorer that fails on some prompts: each such prompt is one reject."""
    ok, rejects = scoring.parse_scores(written(scoring.score(scoring.build_prompts(_headlines(spark, sf_dir)), _count_lines), "answers"))
    lost = rejects.select(F.col("key").cast("long").alias("stock_id"), F.lit(None).cast("double").alias("score"), F.col("message").alias("said"))
    return ok.select("stock_id", "score", F.col("summary").alias("said")).unionByName(lost)


SEEDED = ", ".join(f"('{n}')" for n, _ in seed.MARKETS)


@query(f"SELECT name FROM (SELECT name FROM market UNION SELECT * FROM (VALUES {SEEDED})) WHERE name NOT IN (SELECT name FROM exchange)", "market", "exchange")
def insert_new_markets(spark, sf_dir):
    """Seeded markets and all nations, as far as no market has the name yet."""
    seeds, _ = seed.seed_dims(spark)
    batch = view(spark, sf_dir, "market").select("name", F.lit(None).cast("string").alias("description")).unionByName(seeds.select("name", "description"))
    return maintain.insert_new_markets(view(spark, sf_dir, "exchange"), batch).select("name")


SEED_ROWS = ", ".join(f"('{t}', '{n}', '{m}')" for t, n, m in seed.STOCKS)


@query(f", seeded(ticker, name, market) AS (VALUES {SEED_ROWS}) SELECT CAST(stock_id AS VARCHAR) AS stock_id, ticker, name FROM listing UNION ALL SELECT sha256(ticker), ticker, name FROM seeded", "listing")
def seed_stocks(spark, sf_dir):
    """The stock table after the seeds are merged into it."""
    _, seeds = seed.seed_dims(spark)
    known = view(spark, sf_dir, "listing").select(F.col("stock_id").cast("string").alias("stock_id"), "ticker", "name", F.lit(None).cast("string").alias("market_id"))
    return maintain.upsert_stocks(known, seeds).select("stock_id", "ticker", "name")


@query(
    f""", {LATEST}, {HISTORY}, one AS (SELECT * FROM stock WHERE upper(ticker) = upper('{TICKER}') ORDER BY ticker LIMIT 1)
    SELECT o.stock_id, o.ticker, m.name AS market, (SELECT score FROM latest l WHERE l.stock_id = o.stock_id) AS score,
      (SELECT count(*) FROM history h WHERE h.stock_id = o.stock_id) AS n_readings, least(20, (SELECT count(*) FROM article_stock a WHERE a.stock_id = o.stock_id)) AS n_articles
    FROM one o JOIN market m USING (market_id)""",
    "stock", "market", "sentiment", "article_stock",
)
def stock_by_ticker(spark, sf_dir):
    """The page of one stock, its ticker given in other case."""
    return d.stock_detail(tables(spark, sf_dir), ticker=TICKER.lower()).select("stock_id", "ticker", "market", "score", "n_readings", "n_articles")


@query("SELECT DISTINCT e.user_id, e.k AS stock_id, f.user_id IS NOT NULL AS followed FROM tagged_event e LEFT JOIN user_stock f ON f.user_id = e.user_id AND f.stock_id = e.k", "tagged_event", "user_stock")
def is_followed(spark, sf_dir):
    asked = view(spark, sf_dir, "tagged_event").select("user_id", F.col("k").alias("stock_id")).distinct()
    return d.is_followed(tables(spark, sf_dir), asked)


@query("SELECT invitation_id, email, created_at FROM invitation JOIN account w ON w.user_id = invited_by_id ORDER BY created_at DESC, invitation_id LIMIT 100".replace("email,", "invitation.email,"), "invitation", "account")
def newest_invitations(spark, sf_dir):
    """The hundred newest invitations of all."""
    newest = maintain.invitations_view(view(spark, sf_dir, "invitation"), view(spark, sf_dir, "account"), order="newest")
    return newest.limit(100).select("invitation_id", "email", "created_at")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M') AS minute FROM events", "market")
def request_times(spark, sf_dir):
    """The dates and minutes that requests to the feeds are made of."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", tm.utc_date(F.col("ts")).alias("day"), tm.utc_minute(F.col("ts")).alias("minute"))


@query(f", {HITS} SELECT DISTINCT symbol AS ticker, symbol AS name, (SELECT market_id FROM exchange WHERE name = 'NYSE') AS market_id FROM hits", "exchange")
def stocks_from_search(spark, sf_dir):
    """Hits of all searches as stocks to upsert, with the market that their symbol tells."""
    return maintain.stocks_from_search(_hits(spark, sf_dir), view(spark, sf_dir, "exchange"))


STORED = ("market", "stock", "article", "article_stock", "sentiment", "user_stock", "user_market", "app_user", "invitation")


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in STORED), *STORED)
def load_tables(spark, sf_dir):
    """The nine tables, stored under their schemas and read back."""
    folder = shared_path(spark, "tables")
    for name in STORED:
        own = view(spark, sf_dir, name)
        fields = [c.strip().split(" ") for c in TABLES[name].split(",")]
        own.select(*[(F.col(c) if c in own.columns else F.lit(None)).cast(t).alias(c) for c, t in fields]).write.parquet(f"{folder}/{name}")
    out = None
    for name, df in feeds.load_tables(spark, folder).items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES["stream_ingest"] = QUERIES.pop("stream_ingest_events")
ORACLE_SQL["stream_ingest"] = ORACLE_SQL.pop("stream_ingest_events")
