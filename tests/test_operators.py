import gzip
import itertools
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickerloom.operators import ingest, maintain, rank, scope, scoring
from tickerloom.plans import catalogue
from tickerloom.plans import dashboard as d
from tickerloom.plans.pipeline import run_pipeline
from tickerloom.sources import feeds, landing, seed, storage
from tickerloom.sources.headlines import HeadlineIndex
from tickerloom.streaming.ingest import read_articles, stream_ingest

NOW = datetime(2026, 1, 10)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def make_tables(spark, n_articles=51, bull=True):
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    stock = spark.createDataFrame([(1, "AAA", 1), (2, "BBB", 1), (3, "CCC", 1)], "stock_id long, ticker string, market_id long")
    market = spark.createDataFrame([(1, "NYSE")], "market_id long, name string")
    article = spark.createDataFrame(
        [(i, f"headline {i} 100%", f"u{i}", "s", NOW - timedelta(hours=i)) for i in range(n_articles)],
        "article_id long, headline string, url string, source string, published_at timestamp",
    )
    links = spark.createDataFrame([(i, 1 + i % 2) for i in range(n_articles)], "article_id long, stock_id long")
    sentiment = spark.createDataFrame(
        [(i, 1, 0.5 if bull else 0.0, NOW - timedelta(days=31 - i)) for i in range(31)] + [(100, 2, -0.5, NOW)],
        "sentiment_id long, stock_id long, score double, date timestamp",
    )
    # user 1 watches two stocks, user 2 one without articles or readings, user 3 none
    user_stock = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "user_id long, stock_id long")
    user_market = spark.createDataFrame([(1, 1)], "user_id long, market_id long")
    return d.Tables(users, stock, market, article, links, sentiment, user_stock, user_market)


def test_fallbacks_differ_between_overview_and_feed(spark):
    t = make_tables(spark)
    heads = d.overview_headlines(t, NOW)
    assert {r.user_id: r.n for r in heads.groupBy("user_id").agg(F.count("*").alias("n")).collect()} == {1: 5, 2: 5, 3: 5}
    feed = d.news_feed(t, NOW)
    assert {r.user_id: r.n for r in feed.groupBy("user_id").agg(F.count("*").alias("n")).collect()} == {1: 50, 3: 50}


def test_mood_filter_comes_after_the_fetch_limit(spark):
    t = make_tables(spark, 300)
    got = d.news_feed(t, NOW, mood="bull").where("user_id = 1")
    assert got.count() == 50  # 200 fetched, 100 of them bull
    t = make_tables(spark, 51)
    got = d.news_feed(t, NOW, mood="bear").where("user_id = 1").collect()
    assert len(got) == 25 and not got[0].has_more


def test_has_more_when_exactly_full(spark):
    t = make_tables(spark, 50)
    assert all(r.has_more for r in d.news_feed(t, NOW).collect())
    assert not any(r.has_more for r in d.news_feed(t, NOW, limit=500).collect())


def test_search_takes_wildcards_literally(spark):
    t = make_tables(spark, 5)
    assert scope.headline_contains(t.article, " 3 100% ").count() == 1
    assert scope.headline_contains(t.article, "headline_1").count() == 0
    assert scope.headline_contains(t.article, " ").count() == 5


@pytest.mark.parametrize("text", ["the", "THE end", " nd o", "zz", "é", "aaa", "%", "a_b", "İst", "no such"])
def test_index_finds_what_a_scan_finds(spark, tmp_path_factory, text):
    if not hasattr(spark, "_headlines"):
        said = ["The end of the road", "aaaa", "aa", "a_b 100%", "axb", None, "", "naïve é", "İstanbul rises", "end the", "THE END"] + [f"the news {i}" for i in range(60)]
        spark._headlines = spark.createDataFrame(list(enumerate(said)), "article_id long, headline string")
        spark._index = HeadlineIndex(spark, str(tmp_path_factory.mktemp("index") / "i"), buckets=4).build(spark._headlines)
    want = rows(scope.headline_contains(spark._headlines, text), "article_id")
    assert rows(spark._index.find(text), "article_id") == want == rows(scope.headline_contains(spark._headlines, text, spark._index), "article_id")


def test_search_opens_few_files(spark, tmp_path):
    articles = spark.range(4000).select(F.col("id").alias("article_id"), F.concat(F.lit("w"), F.md5(F.col("id").cast("string"))).alias("headline"))
    index = HeadlineIndex(spark, str(tmp_path / "i"), buckets=64).build(articles)
    text = articles.where("article_id = 77").first()["headline"][5:25]
    assert [r["article_id"] for r in index.find(text).collect()] == [77]
    assert index.opened <= 4
    index.find("ab")
    assert index.opened == 64


def test_users_with_one_watchlist_share_a_page(spark):
    t = make_tables(spark)
    t.user_stock = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 1), (2, 1), (3, 1)], "user_id long, stock_id long")
    members, sets = scope.watch_sets(t.user_stock)
    assert rows(members, "user_id", "set_id") == [(1, 1), (2, 1), (3, 3)] and rows(sets, "set_id", "stock_id") == [(1, 1), (1, 2), (3, 1)]
    feed = d.news_feed(t, NOW)
    page = lambda u: rows(feed.where(F.col("user_id") == u), "rank", "article_id", "tickers")
    assert page(1) == page(2) != page(3) and len(page(1)) == 50


def test_joins_by_stock_need_no_shuffle_of_bucketed_tables(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = make_tables(spark)
        b = d.bucketed_by_stock(t, 4)
        watched = d.watch_latest(b)
        plan = watched._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert rows(watched, "user_id", "stock_id", "ticker") == rows(d.watch_latest(t), "user_id", "stock_id", "ticker")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_ticker_overrides_scope_and_is_case_sensitive(spark):
    t = make_tables(spark, 10)
    assert d.news_feed(t, NOW, ticker="BBB").where("user_id = 2").count() == 5
    assert d.news_feed(t, NOW, ticker="bbb").count() == 0
    assert scope.find_stock(t.stock, "bbb").first().ticker == "BBB"


def test_strongest_sentiment_tie_takes_smallest_stock(spark):
    links = spark.createDataFrame([(1, 2), (1, 1)], "article_id long, stock_id long")
    latest = spark.createDataFrame([(1, -0.5), (2, 0.5)], "stock_id long, score double")
    assert rows(rank.top_sentiment(links, latest), "article_id", "stock_id", "score") == [(1, 1, -0.5)]


def test_stock_detail_counts_capped_lists(spark):
    got = {r.ticker: r for r in d.stock_detail(make_tables(spark)).collect()}
    assert (got["AAA"].n_readings, got["AAA"].n_articles) == (30, 20)
    assert got["AAA"].first_reading == NOW - timedelta(days=30)
    assert got["CCC"].score is None and got["CCC"].label is None


def test_missing_scores_differ_by_query(spark):
    t = make_tables(spark)
    board = {(r.user_id, r.ticker): r for r in d.sentiment_board(t).collect()}
    assert (board[2, "CCC"].shown_score, board[2, "CCC"].label) == (0.0, "Neutral")
    assert rows(d.watchlist(t).where("user_id = 2"), "badge") == [("No data",)]
    assert rows(d.portfolio_mood(t), "user_id", "label")[1:] == [(2, None), (3, None)]


def test_top_k_is_a_prefix_and_one_user_equals_all(spark):
    t = make_tables(spark, 60)
    small = set(rows(scope.user_newest(scope.stock_newest(t.article_stock, t.article, 5), t.user_stock, 5), "user_id", "article_id"))
    assert small <= set(rows(scope.user_newest(scope.stock_newest(t.article_stock, t.article, 6), t.user_stock, 6), "user_id", "article_id"))
    everyone = rows(d.overview(t, NOW).where("user_id = 1"), "articles_24h", "readings", "portfolio_score")
    t.users, t.user_stock = t.users.where("user_id = 1"), t.user_stock.where("user_id = 1")
    assert rows(d.overview(t, NOW), "articles_24h", "readings", "portfolio_score") == everyone


def test_users_in_groups_and_wanted_articles_are_those_of_one_look(spark, tmp_path):
    rnd = random.Random(3)
    links = spark.createDataFrame([(a, rnd.randrange(30)) for a in range(400) for _ in range(2)], "article_id long, stock_id long").distinct()
    articles = spark.createDataFrame([(a, NOW - timedelta(hours=rnd.randrange(200))) for a in range(400)], "article_id long, published_at timestamp")
    follows = spark.createDataFrame([(u, s) for u in range(40) for s in rnd.sample(range(30), 1 + u % 12)], "user_id long, stock_id long")
    newest = scope.stock_newest(links, articles, 12).withColumn("fits", F.col("article_id") % 3 == 0).cache()
    plain = rank.top_k_per_group(
        scope.user_articles(links, follows).join(articles, "article_id"), ["user_id"], [F.desc("published_at"), F.asc("article_id")], 12
    )
    own = ("user_id", "article_id", "rank")
    for at_once in (60, 1 << 28):
        assert rows(scope.user_newest(newest.drop("fits"), follows, 12, at_once=at_once), *own) == rows(plain, *own)
        got = scope.user_newest(newest, follows, 12, wanted="fits", at_once=at_once, spare=1.0)
        assert rows(got, *own) == rows(plain.where("article_id % 3 = 0"), *own)


def test_a_feed_leaves_only_tables_that_it_reads(spark, sf, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(storage, "shared_path", lambda _, label: made.append(label) or f"file://{tmp_path}/{label}.{len(made)}")
    assert catalogue.QUERIES["news_feed_mood"](spark, sf).count() > 0
    left = {p.name.split(".")[0] for p in tmp_path.iterdir()}
    assert {"article", "article-stock", "user-stock", "stock-newest"} <= set(made)
    assert left <= {"newest", "facts", "floored", "short", "unfloored", "watch-members"}


@pytest.mark.parametrize("given, n", [(None, 50), ("x", 50), (0, 50), (-3, 50), (60, 60), ("70", 70), (9999, 500)])
def test_limits(given, n):
    assert scope.clamp_limit(given) == n
    assert scope.next_limit(480) == 500


def test_empty_tables_give_empty_results(spark):
    t = make_tables(spark)
    for name in ("article", "article_stock", "sentiment", "user_stock", "user_market"):
        setattr(t, name, getattr(t, name).limit(0))
    t.__post_init__()
    assert d.news_feed(t, NOW).count() == 0
    assert rows(d.overview(t, NOW), "user_id", "articles_24h", "portfolio_score") == [(1, 0, None), (2, 0, None), (3, 0, None)]
    assert rows(d.pipeline_status(t, NOW), "last_run", "label") == [(None, "Never run")]


# ---- ingest ----------------------------------------------------------------------------------


def news(spark, items):
    return spark.createDataFrame(items, "url string, headline string, summary string, source string, datetime long")


def test_validation_keeps_blanks_and_empty_summaries(spark):
    df = news(spark, [("u", " ", "", "s", 1), ("", "h", None, "s", 1), (None, "h", None, "s", 1), ("v", "", None, "s", 1)])
    got = ingest.normalize_news(ingest.valid_articles(df)).collect()
    assert [(r.url, r.summary) for r in got] == [("u", "")]


def test_first_feed_wins_and_reruns_insert_nothing(spark):
    a = ingest.normalize_news(news(spark, [("u", "general", None, "s", 1)]))
    b = ingest.normalize_news(news(spark, [("u", "company", None, "s", 1), ("v", "x", None, "s", 2), ("v", "y", None, "s", 1)]))
    batch = ingest.union_feeds(a, b)
    stored = spark.createDataFrame([], "url string")
    first = ingest.insert_new_articles(stored, batch)
    assert rows(first, "url", "headline") == [("u", "general"), ("v", "x")]
    assert ingest.insert_new_articles(first, batch).count() == 0
    assert rows(ingest.insert_new_articles(stored, batch.orderBy(F.desc("headline"))), "url", "headline") == rows(first, "url", "headline")


def test_rejects_cost_a_row_not_a_batch(spark):
    df = ingest.normalize_news(news(spark, [("u", "h", None, None, 1), ("v", "h", None, "s", 1)]))
    good, bad = ingest.split_storable(df)
    assert rows(good, "url") == [("v",)] and rows(bad, "stage", "key") == [("store", "u")]


def full_run(spark, scorer=None, tables=None):
    stocks = spark.createDataFrame([("s1", "AAPL"), ("s2", "EDP.LS"), ("s3", "BTC-USD"), ("s4", "IDLE")], "stock_id string, ticker string")
    if tables is None:
        tables = {
            "stock": stocks,
            "user_stock": spark.createDataFrame([("u", "s1"), ("u", "s2"), ("u", "s3")], "user_id string, stock_id string"),
            "article": spark.createDataFrame([("a0", "old", "old-url", NOW)], "article_id string, headline string, url string, published_at timestamp"),
            "article_stock": spark.createDataFrame([("a0", "s3")], "article_id string, stock_id string"),
        }
    at = int((NOW - timedelta(days=1)).timestamp()) + 0
    general = news(spark, [("g", "profit rises", None, "s", at)])
    company = spark.createDataFrame(
        [("AAPL", "g", "loss", None, "s", at), ("AAPL", "old-url", "old", None, "s", at), ("IDLE", "z", "z", None, "s", at), ("AAPL", "c", "growth", "", "s", at)],
        "ticker string, url string, headline string, summary string, source string, datetime long",
    )
    tagged = spark.createDataFrame(
        [("t", "x", "d", "2026-01-09T10:00:00Z", "s", [("EDP.LS",), ("EDP.LS",), ("AAPL",)]), ("t2", "", None, "2026-01-09T10:00:00Z", "s", [])],
        "url string, title string, description string, published_at string, source string, entities array<struct<symbol:string>>",
    )
    return tables, run_pipeline(tables, general, company, tagged, NOW, scorer)


def test_full_run(spark):
    _, got = full_run(spark)
    assert rows(got.articles, "url", "headline") == [("c", "growth"), ("g", "profit rises"), ("t", "x")]
    assert got.links.count() == 4  # AAPL: g, old-url, c; EDP.LS: t once
    assert got.report.first().asDict() == {"fetched": 6, "saved": 3, "tags": 5, "new_links": 4, "sentiments": 3}
    assert rows(got.readings, "stock_id", "score") == [("s1", 1.0), ("s2", 0.0), ("s3", 0.0)]


def test_second_run_adds_only_readings(spark):
    tables, got = full_run(spark)
    again = dict(tables)
    again["article"] = tables["article"].unionByName(got.articles.select("article_id", "headline", "url", "published_at"))
    again["article_stock"] = tables["article_stock"].unionByName(got.links)
    _, second = full_run(spark, tables=again)
    report = second.report.first()
    assert (report.saved, report.new_links, report.tags) == (0, 0, 5)


def test_failing_scorer_costs_its_row(spark):
    def scorer(prompts):
        if any("EDP.LS" in p for p in prompts):
            raise RuntimeError("boom")
        return [json.dumps({"score": 0.1, "summary": "s"}) for _ in prompts]

    _, got = full_run(spark, scorer)
    assert rows(got.readings, "stock_id", "score") == [("s1", 0.1), ("s3", 0.1)]
    assert rows(got.rejects, "stage", "key", "message") == [("score", "s2", "boom"), ("tagged", "t2", "url or title is missing")]


def test_missing_feeds_and_bad_rows_are_rejects(spark, tmp_path):
    tables, _ = full_run(spark)
    general = news(spark, [("g", "profit", None, "s", 1), (None, "h", None, "s", 1), ("v", "", None, "s", 1), ("w", "h", None, None, 1)])
    company, why = feeds.landed(feeds.read_company_news, spark, str(tmp_path / "nothing"), "2026-01-01", "2026-01-02")
    assert company is None and "nothing" in why
    got = run_pipeline(tables, general, company, None, NOW)
    assert rows(got.articles, "url") == [("g",)] and got.report.first().fetched == 4
    assert sorted((r.stage, r.key or "") for r in got.rejects.collect()) == [("company", ""), ("general", ""), ("general", "v"), ("store", "w"), ("tagged", "")]


def test_first_to_arrive_wins_within_a_feed(spark, tmp_path):
    for name, items in (("0001.json", [("u", "first", 9), ("v", "a", 5), ("v", "b", 1)]), ("0002.json", [("u", "later", 2)])):
        (tmp_path / name).write_text("\n".join(json.dumps({"category": "general", "url": u, "headline": h, "source": "s", "datetime": t}) for u, h, t in items))
    batch = ingest.union_feeds(ingest.normalize_news(feeds.read_market_news(spark, str(tmp_path))))
    got = ingest.insert_new_articles(spark.createDataFrame([], "url string"), batch)
    assert rows(got, "url", "headline") == [("u", "first"), ("v", "a")]


def test_newest_of_users_left_short_by_their_floor(spark):
    """A user of one old and many young stocks: the floor leaves too few, the second look finds all."""
    links = [(100 * s + i, s) for s in range(6) for i in range(40)]
    articles = [(a, NOW - timedelta(days=(1000 if s == 0 else 1) * (a % 100) + s)) for a, s in links]
    # two stocks share all their articles, so what the floor keeps is half of what it counts
    links += [(100 + i, 7) for i in range(40)] + [(100 + i, 8) for i in range(40)]
    follows = [(1, s) for s in range(9)] + [(2, 1), (2, 7), (2, 8)] + [(3, 0)] + [(4, 99)]
    frame = spark.createDataFrame
    la, aa, ua = frame(links, "article_id int, stock_id int"), frame(articles, "article_id int, published_at timestamp"), frame(follows, "user_id int, stock_id int")
    date = dict(articles)
    for k in (1, 5, 30, 60):
        for spare in (0.1, 1.0, 2.0):
            want = []
            for u in (1, 2, 3):
                own = {a for a, s in links if (u, s) in follows}
                want += [(u, a, i + 1) for i, a in enumerate(sorted(own, key=lambda a: (-date[a].timestamp(), a))[:k])]
            got = scope.user_newest(scope.stock_newest(la, aa, k), ua, k, spare).select("user_id", "article_id", "rank")
            assert sorted(map(tuple, got.collect())) == sorted(want), (k, spare)


def test_links_only_to_requested_symbols(spark):
    asked = spark.createDataFrame([(i, f"T{i:02}.L") for i in range(12)], "stock_id int, ticker string")
    plan = ingest.request_batches(asked.repartition(5))
    assert sorted((r["ticker"], r["batch"]) for r in plan.collect()) == [(f"T{i:02}.L", i // 5) for i in range(12)]
    tagged = spark.createDataFrame(
        [("u", [("T00.L",), ("T05.L",)], 0), ("v", [("T05.L",), ("T05.L",)], 1), ("w", [("T00.L",)], None)],
        "url string, entities array<struct<symbol:string>>, batch long",
    )
    ids = spark.createDataFrame([("u", 9), ("v", 8), ("w", 7)], "url string, article_id int")
    assert rows(ingest.link_entities(tagged, plan, ids), "article_id", "stock_id") == [(8, 5), (8, 5), (9, 0)]
    assert len(rows(ingest.link_entities(tagged.drop("batch"), plan, ids), "stock_id")) == 5


def put(folder, name, records, cut=0):
    folder.mkdir(exist_ok=True)
    text = "\n".join(r if isinstance(r, str) else json.dumps(r) for r in records).encode()
    (folder / name).write_bytes(gzip.compress(text)[:-cut] if cut else text)


def test_torn_lines_cut_files_and_failed_requests(spark, tmp_path):
    news = {"category": "general", "datetime": 5, "headline": "h", "source": "s", "url": "u"}
    put(tmp_path / "g", "a.json", [news, '{"url": "torn'])
    put(tmp_path / "g", "b.json.gz", [news | {"url": f"lost{i}"} for i in range(500)], cut=20)
    put(tmp_path / "c", "a.json", [{"ticker": "AAA", "error": "HTTP 429"}, news | {"ticker": "AAA", "url": "c"}])
    put(tmp_path / "t", "a.json", [{"batch": 7, "error": "HTTP 402"}])
    stock = spark.createDataFrame([("s1", "AAA")], "stock_id string, ticker string")
    own = {
        "stock": stock, "user_stock": stock.select(F.lit("u").alias("user_id"), "stock_id"),
        "article": spark.createDataFrame([], "article_id string, url string, headline string, published_at timestamp"),
        "article_stock": spark.createDataFrame([], "article_id string, stock_id string"),
    }
    got = run_pipeline(own, landing.land_general(spark, str(tmp_path / "g")), landing.land_company(spark, str(tmp_path / "c")), landing.land_tagged(spark, str(tmp_path / "t")), NOW)
    assert rows(got.articles, "url") == [("c",), ("u",)]
    found = rows(got.rejects, "stage", "key", "message")
    assert [(s, k, m) for s, k, m in found if m != "the file is cut short"] == [
        ("company", "AAA", "HTTP 429"), ("general", '{"url": "torn', "no JSON"), ("tagged", "7", "HTTP 402"),
    ]
    assert [s for s, k, m in found if m == "the file is cut short" and k.endswith("b.json.gz")] == ["general"]
    gone = landing.land_general(spark, str(tmp_path / "none"))
    assert gone.rows is None and "none" in gone.rejects.first()["message"]
    ledger = landing.file_ledger(spark, str(tmp_path / "g"))
    assert ledger.count() == 2 and ledger.where("fault is null").count() == 1


def test_files_that_are_not_packed_are_never_opened(spark, tmp_path):
    put(tmp_path / "g", "a.json", ["{}"] * 1000)
    put(tmp_path / "g", "c.json.gz", ["{}"] * 1000, cut=9)
    (tmp_path / "g" / "b.json.gz").write_bytes(gzip.compress(b"{}\n" * 1000))
    (tmp_path / "g" / "d.json.gz").write_bytes(b"plain")
    (tmp_path / "g" / "e.json.gz").write_bytes(gzip.compress(b"x" * 99)[:10] + b"\xff" * 20)
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")  # a larger file would stop the job if it were opened
    try:
        ledger = rows(landing.file_ledger(spark, str(tmp_path / "g")).withColumn("name", F.element_at(F.split("file", "/"), -1)).na.fill("", ["fault"]), "name", "fault")
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)
    assert ledger == [("a.json", ""), ("b.json.gz", ""), ("c.json.gz", "the file is cut short"), ("d.json.gz", "the file is not gzip"), ("e.json.gz", "the file is not gzip")]


def test_the_full_run_leaves_only_tables_that_it_returns(spark, sf, tmp_path, monkeypatch):
    made = []
    path = lambda _, label: made.append(label) or f"file://{tmp_path}/{label}.{len(made)}"
    monkeypatch.setattr(storage, "shared_path", path)
    monkeypatch.setattr(catalogue, "shared_path", path)
    assert catalogue.QUERIES["run_pipeline"](spark, sf).count() > 0
    assert {"general", "company", "tagged", "company-records"} <= set(made)
    assert {p.name.split(".")[0] for p in tmp_path.iterdir()} == {"new-articles", "new-links", "readings", "rejects"}


def test_stream_twice_is_once(spark, tmp_path):
    feed, store, marks = (str(tmp_path / n) for n in ("feed", "store", "marks"))
    item = {"category": "general", "datetime": 5, "headline": "h", "source": "s", "url": "u"}
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "a.json").write_text("\n".join(json.dumps(item | {"url": u}) for u in ("u", "v", "u", "")))
    stream_ingest(spark, feed, store, marks)
    assert rows(read_articles(spark, store), "url") == [("u",), ("v",)]
    (tmp_path / "feed" / "b.json").write_text("\n".join(json.dumps(item | {"url": u}) for u in ("v", "w")))
    stream_ingest(spark, feed, store, marks)
    stream_ingest(spark, feed, store, marks)
    assert rows(read_articles(spark, store), "url") == [("u",), ("v",), ("w",)]


# ---- sources -----------------------------------------------------------------------------------


def test_readers(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"data": [{"uuid": "1", "title": "t", "url": "u", "published_at": "2026-01-01T00:00:30Z", "entities": [{"symbol": "A"}]}]}) + "\n" + json.dumps({"other": 1}))
    assert feeds.read_tagged_news(spark, str(tmp_path / "t.json")).count() == 1
    assert feeds.read_tagged_news(spark, str(tmp_path / "t.json"), datetime(2026, 1, 1, 0, 1)).count() == 0
    (tmp_path / "s.json").write_text(json.dumps({"count": 2, "result": [{"symbol": "A", "type": "x"}, {"symbol": "B"}]}))
    assert rows(feeds.read_symbol_search(spark, str(tmp_path / "s.json")), "pos", "symbol") == [(0, "A"), (1, "B")]
    for day in ("2026-01-01", "2026-01-02"):
        p = tmp_path / "c" / "ticker=A" / f"dt={day}"
        p.mkdir(parents=True)
        (p / "x.json").write_text(json.dumps({"url": day, "headline": "h", "datetime": 1, "category": "general"}))
    assert rows(feeds.read_company_news(spark, str(tmp_path / "c"), "2026-01-02", "2026-01-09"), "url", "ticker") == [("2026-01-02", "A")]
    assert feeds.read_market_news(spark, str(tmp_path / "c")).count() == 2
    with pytest.raises(ValueError):
        feeds.read_market_news(spark, "x", "other")


def test_seed(spark):
    markets, stocks = seed.seed_dims(spark)
    assert (markets.count(), stocks.count()) == (6, 21)


# ---- maintenance --------------------------------------------------------------------------------


def test_market_inference_falls_through_candidates(spark):
    tickers = spark.createDataFrame([("AAPL",), ("X.DE",), ("Y.L",), (None,)], "ticker string")
    markets = spark.createDataFrame([("2", "NASDAQ"), ("3", "LSE")], "market_id string, name string")
    got = {r.ticker: r.market_id for r in maintain.infer_market(tickers, markets).collect()}
    assert got == {"AAPL": "2", "X.DE": "3", "Y.L": "3", None: "3"}
    assert maintain.infer_market(tickers, markets.limit(0)).where("market_id is null").count() == 4


def test_upsert_overwrites_and_inserts(spark):
    old = spark.createDataFrame([("1", "A", "a", "m"), ("2", "B", "b", "m")], "stock_id string, ticker string, name string, market_id string")
    new = spark.createDataFrame([("B", "bb", "n"), ("C", "c", "n")], "ticker string, name string, market_id string")
    got = rows(maintain.upsert_stocks(old, new), "ticker", "name", "market_id")
    assert got == [("A", "a", "m"), ("B", "bb", "n"), ("C", "c", "n")]


def test_upsert_takes_the_last_row_of_a_ticker(spark):
    old = spark.createDataFrame([("1", "A", "a", "m")], "stock_id string, ticker string, name string, market_id string")
    new = spark.createDataFrame(
        [("A", "y", "n", 2), ("A", "x", "m", 1), ("B", "c", "m", 4), ("B", "b", "n", 3), (None, "z", "n", 5)], "ticker string, name string, market_id string, pos int"
    )
    assert rows(maintain.upsert_stocks(old, new, ["pos"]), "ticker", "name", "market_id") == [("A", "y", "n"), ("B", "c", "m")]
    assert rows(maintain.upsert_stocks(old, new.drop("pos")), "ticker", "name") == [("A", "y"), ("B", "c")]


def test_markets_insert_only_new_names(spark):
    old = spark.createDataFrame([("1", "A")], "market_id string, name string")
    new = spark.createDataFrame([("9", "A"), ("2", "B"), ("3", "B")], "market_id string, name string")
    assert rows(maintain.insert_new_markets(old, new), "market_id", "name") == [("2", "B")]


@pytest.mark.parametrize("order", list(itertools.permutations(range(3))))
def test_follow_log_last_op_wins(spark, order):
    log = [("u", 1, "ADD", 1), ("u", 1, "DELETE", 2), ("v", 2, "ADD", 3)]
    state = spark.createDataFrame([("u", 1), ("w", 5)], "user_id string, stock_id int")
    frame = spark.createDataFrame([log[i] for i in order], "user_id string, stock_id int, op string, seq int")
    assert rows(maintain.apply_follow_log(state, frame, ("user_id", "stock_id")), "user_id", "stock_id") == [("v", 2), ("w", 5)]


def test_cascade_from_market_reaches_readings(spark):
    t = {
        "market": spark.createDataFrame([(1,), (2,)], "market_id int"),
        "stock": spark.createDataFrame([(10, 1), (20, 2)], "stock_id int, market_id int"),
        "sentiment": spark.createDataFrame([(10,), (20,)], "stock_id int"),
        "user_market": spark.createDataFrame([(1,)], "market_id int"),
    }
    got = maintain.cascade_delete(t, "market", spark.createDataFrame([(1,)], "market_id int"))
    assert {k: v.count() for k, v in got.items()} == {"market": 1, "stock": 1, "sentiment": 1, "user_market": 0}


def test_search_limits_and_dedupes(spark):
    hits = [("q", i, f"S{i % 12}", "d", "Common Stock") for i in range(24)] + [("q", 30, "", "d", "Common Stock"), (" ", 1, "A", "d", "Common Stock"), ("", 2, "B", "d", "Common Stock"), ("q", 31, "Z", "d", "ETF")]
    got = maintain.search_stocks(spark.createDataFrame(hits, "query string, pos int, symbol string, description string, type string"))
    assert [r.symbol for r in got.where("query = 'q'").orderBy("rank").collect()] == [f"S{i}" for i in range(10)]
    assert rows(got.where("query <> 'q'"), "query", "symbol") == [(" ", "A")]  # only the empty query is refused


def test_invitation_order_puts_pending_first(spark):
    inv = spark.createDataFrame(
        [(1, "a", 1, NOW, 2, NOW), (2, "b", 1, None, None, NOW - timedelta(1)), (3, "c", 1, None, None, NOW), (4, "d", 99, None, None, NOW)],
        "invitation_id int, email string, invited_by_id int, accepted_at timestamp, accepted_by_user_id int, created_at timestamp",
    )
    users = spark.createDataFrame([(1, "x"), (2, "y")], "user_id int, email string")
    assert [r.invitation_id for r in maintain.invitations_view(inv, users).collect()] == [3, 2, 1]
    assert [r.invitation_id for r in maintain.invitations_view(inv, users, "created").collect()] == [1, 3, 2]


def test_admission_and_acceptance(spark):
    users = spark.createDataFrame([("old",)], "external_id string")
    inv = spark.createDataFrame([(1, "a@b.c", None, None), (2, "d@e.f", NOW, "u")], "invitation_id int, email string, accepted_at timestamp, accepted_by_user_id string")
    ups = spark.createDataFrame([("old", "a@b.c"), ("n1", " A@B.C"), ("n2", "a@b.c"), ("n3", "d@e.f"), ("n4", None)], "external_id string, email string")
    got = maintain.admit_signups(ups, users, inv)
    assert rows(got, "external_id", "outcome") == [("n1", "created"), ("n2", "blocked"), ("n3", "blocked"), ("n4", "blocked"), ("old", "known")]
    assert maintain.accept_invitations(inv, got, NOW).where("accepted_at is null").count() == 0


def test_revoke(spark):
    inv = spark.createDataFrame([(1, None), (2, NOW)], "invitation_id int, accepted_at timestamp")
    got = maintain.revocable(inv, spark.createDataFrame([(1,), (2,), (3,)], "invitation_id int"))
    assert rows(got, "invitation_id", "outcome") == [(1, "revoked"), (2, "accepted"), (3, "not_found")]
    assert rows(maintain.remaining_invitations(inv, got), "invitation_id") == [(2,)]


def test_word_scorer(spark):
    df = spark.createDataFrame([(["Profit rises", "a loss"],), (["none"],)], "h array<string>")
    assert [round(r[0], 3) for r in df.select(scoring.word_score(F.col("h"))).collect()] == [0.333, 0.0]
