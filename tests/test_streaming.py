"""Streams against one batch over everything: the article store, kept lists, failures halfway."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickerloom.operators import rank
from tickerloom.sources import storage
from tickerloom.streaming import ingest
from tickerloom.streaming.newest import kept_articles, kept_readings
from tickerloom.streaming.store import ARTICLES, ArticleStore

DAY = datetime(2026, 1, 1)


def articles(spark, numbers):
    rows = [(f"u{i}", f"h{i}", None, "s", DAY + timedelta(minutes=i), f"id{i}") for i in numbers]
    return spark.createDataFrame(rows, ARTICLES)


def urls(df):
    return sorted(r["url"] for r in df.collect())


def test_a_batch_opens_as_much_of_a_table_ten_times_as_large(spark, tmp_path):
    opened, asked = [], articles(spark, [*range(3), *range(10**6, 10**6 + 3)])
    for n in (2_000, 20_000):
        store = ArticleStore(spark, str(tmp_path / str(n)), rows_per_bucket=100)
        store.add(articles(spark, range(n)).repartition(4), 0)
        assert urls(store.find(asked)) == ["u0", "u1", "u2"]
        opened.append(store.opened)
        assert store.runs()[0].buckets >= n // 200
    assert max(opened[1]) <= 6 and opened[1][1] <= 4 and opened[0][1] <= 4


def test_runs_are_merged_and_a_failed_try_is_not_seen(spark, tmp_path):
    store = ArticleStore(spark, str(tmp_path / "s"), rows_per_bucket=4, fan=3)
    for b in range(5):
        store.merge(b)
        store.add(articles(spark, range(3 * b, 3 * b + 5)), b)
    assert len(store.runs()) == 3 and store.runs()[0].last == 2
    want = sorted(f"u{i}" for i in range(17))
    assert urls(store.read()) == want
    # rows without marks: a batch that died halfway
    articles(spark, [99]).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(str(tmp_path / "s/rows/run=5-5-1-1"))
    assert urls(store.read()) == want
    # the last batch again, with more in it
    store.add(articles(spark, [0, 14, 50]), 4)
    assert urls(store.read()) == sorted(f"u{i}" for i in [*range(14), 14, 50])
    store.add(articles(spark, []), 5)
    assert urls(store.find(articles(spark, [50, 77]))) == ["u50"]


def test_a_merge_that_failed_halfway_is_made_again(spark, tmp_path, monkeypatch):
    store = ArticleStore(spark, str(tmp_path / "s"), rows_per_bucket=4, fan=2)
    store.add(articles(spark, range(4)), 0)
    store.add(articles(spark, range(4, 8)), 1)
    removed = []
    monkeypatch.setattr(store, "_remove", removed.append)  # dies before it removes what it merged
    store.merge(2)
    assert removed and len(store.runs()) == 1
    assert urls(store.read()) == sorted(f"u{i}" for i in range(8))


def news(i, **more):
    return {"category": "general", "datetime": 60 * i, "headline": f"h{i}", "source": "s", "url": f"u{i}"} | more


def land(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))


def test_rejects_of_a_stream_and_a_batch_that_dies(spark, tmp_path):
    feed, table, marks = tmp_path / "feed", str(tmp_path / "table"), str(tmp_path / "marks")
    land(feed, "a.json", [news(1), news(2, url=""), news(3, source=None), '{"url": "cut', news(1)])
    calls = []

    def dies_once(valid, store, batch_id):
        calls.append(batch_id)
        if len(calls) == 1:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        ingest.stream_ingest(spark, str(feed), table, marks, then=dies_once)
    land(feed, "b.json", [news(1), news(4)])
    ingest.stream_ingest(spark, str(feed), table, marks, then=dies_once)
    assert calls == [0, 0, 1]
    assert urls(ingest.read_articles(spark, table)) == ["u1", "u4"]
    assert sorted(r["stage"] + ":" + str(r["key"]) for r in ingest.read_rejects(spark, table).collect()) == ["general:", 'general:{"url": "cut', "store:u3"]


def test_readings_in_any_order_are_kept_as_a_window_would(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(s, 100 * s + i, rnd.random(), DAY + timedelta(hours=rnd.randrange(40))) for s in range(12) for i in range(s * 4)] + [(None, 1, 0.5, DAY)]
    rnd.shuffle(rows)
    ddl = "stock_id long, sentiment_id long, score double, date timestamp"
    kept = kept_readings(spark, str(tmp_path / "kept"), k=7, key="long")
    for b in range(10):
        part = rows[b::10]
        kept.update(spark.createDataFrame(part + part[:2] + rows[:1], ddl), b)
    kept.update(spark.createDataFrame(rows[9::10], ddl), 9)  # the last batch again
    every = spark.createDataFrame(rows, ddl).where("stock_id is not null")
    plain = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    own = ("stock_id", "rank", "sentiment_id", "score", "date")
    assert plain(kept.read(), *own) == plain(rank.sentiment_history(every, 7), *own)
    latest = ("stock_id", "sentiment_id", "score", "date")
    assert plain(kept.read().where("rank = 1"), *latest) == plain(rank.latest_sentiment(every), *latest)


def test_company_news_keeps_links_and_newest_articles(spark, tmp_path):
    feed, table = tmp_path / "feed", str(tmp_path / "table")
    stocks = spark.createDataFrame([("s1", "A"), ("s2", "B")], "stock_id string, ticker string")
    newest = kept_articles(spark, str(tmp_path / "kept"), k=2)
    # the article that came first keeps its time, for links that come later too
    for name, records in (("a", [news(5, ticker="A"), news(1, ticker="A"), news(9, ticker="X")]), ("b", [news(5, ticker="B", datetime=0), news(7, ticker="A"), news(2, ticker="B")])):
        land(feed, f"{name}.json", records)
        ingest.stream_company_news(spark, str(feed), table, str(tmp_path / "marks"), stocks, newest)
    got = sorted((r["stock_id"], r["rank"], int(r["published_at"].timestamp())) for r in newest.read().collect())
    assert got == [("s1", 1, 420), ("s1", 2, 300), ("s2", 1, 300), ("s2", 2, 120)]
    assert ingest.read_links(spark, table).count() == 5


def test_what_a_stream_writes_on_the_way_is_removed(spark, tmp_path, monkeypatch):
    feed, table, shared = tmp_path / "feed", str(tmp_path / "table"), tmp_path / "shared"
    stocks = spark.createDataFrame([("s1", "A"), ("s2", "B")], "stock_id string, ticker string")
    newest = kept_articles(spark, str(tmp_path / "kept"), k=2)
    made = []
    monkeypatch.setattr(storage, "shared_path", lambda _, label: made.append(label) or f"file://{shared}/{label}-{len(made)}")
    for name in "ab":
        land(feed, f"{name}.json", [news(i, ticker=t) for i in range(5) for t in "AB"])
        ingest.stream_company_news(spark, str(feed), table, str(tmp_path / "marks"), stocks, newest)
    assert "batch" in made and list(shared.iterdir()) == []
    assert ingest.read_links(spark, table).count() == 10 and newest.read().count() == 4


def test_ids_that_are_hashes_of_urls_are_not_stored(spark, tmp_path):
    store = ArticleStore(spark, str(tmp_path / "s"), rows_per_bucket=4, fan=2)
    plain = articles(spark, range(3)).withColumn("article_id", F.sha2("url", 256))
    for b, rows in enumerate((plain, articles(spark, [7]))):
        store.add(rows, b)
    want = sorted((r["url"], r["article_id"]) for r in plain.unionByName(articles(spark, [7])).collect())
    own = lambda df: sorted((r["url"], r["article_id"]) for r in df.collect())
    stored = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "s/rows"))
    assert [r["article_id"] for r in stored.collect() if r["article_id"]] == ["id7"]
    assert own(store.read()) == own(store.find(articles(spark, range(9)))) == want
    store.merge(2)
    assert len(store.runs()) == 1 and own(store.read()) == want


def test_a_crowded_batch_asks_no_bitmaps(spark, tmp_path):
    store = ArticleStore(spark, str(tmp_path / "s"), rows_per_bucket=10_000)
    store.add(articles(spark, range(4_000)), 0)
    assert urls(store.find(articles(spark, range(3_990, 8_000)))) == [f"u{i}" for i in range(3_990, 4_000)]
    assert store.opened == (0, 1)
    assert urls(store.find(articles(spark, [1, 9_999]))) == ["u1"] and store.opened[0] == 1
