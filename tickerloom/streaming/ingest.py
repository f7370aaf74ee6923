"""Repeated runs over a growing feed folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.ingest import insert_new_articles, invalid_articles, normalize_news, split_storable, unreadable, valid_articles
from ..sources.schemas import CORRUPT, NEWS
from ..sources.storage import put, scratch, written
from .newest import KeptNewest
from .store import ArticleStore, with_ids


def stream_ingest(
    spark: SparkSession, feed_dir: str, table_dir: str, checkpoint: str, files_per_batch: int = 1000,
    store: ArticleStore | None = None, more: str = "", then: Callable[[DataFrame, ArticleStore, int], None] | None = None,
) -> int:
    """Take in all feed files not yet seen, then stop; returns the number of micro-batches.

    Articles are de-duplicated against the table, not by a watermark: a url may come back at any
    age. A batch is read once; it asks the store's bitmaps which of its buckets may hold its urls and
    opens only these, and what it wrote on the way is removed at its end.
    Its rows and its rejects (stage, key, message) are folders named by the batch, written anew when
    it is run again, so a batch that failed halfway neither doubles nor loses rows. ``then`` is called
    with a batch's valid records, the store and the batch's number, and must bear to be called again;
    ``more`` names columns of the records that it needs.
    """
    store = store or ArticleStore(spark, table_dir)
    source = spark.readStream.schema(", ".join(filter(None, (NEWS, more, f"{CORRUPT} string")))).option("maxFilesPerTrigger", files_per_batch)
    source = source.option("columnNameOfCorruptRecord", CORRUPT).json(feed_dir)

    taken = []

    def take_in(batch: DataFrame, batch_id: int) -> None:
        taken.append(batch_id)
        with scratch(spark):
            batch = written(batch, "batch")  # read once, for rows, for rejects and for links
            good = batch.where(f"{CORRUPT} is null").drop(CORRUPT)
            valid = valid_articles(good)
            rows, refused = split_storable(normalize_news(valid))
            rejects = unreadable(batch, "general").unionByName(invalid_articles(good, "general")).unionByName(refused)
            put(rejects, f"{table_dir}/rejects/batch={batch_id}", mode="overwrite")
            rows = rows.select("url", "headline", "summary", "source", "published_at")
            none = spark.createDataFrame([], "url string")
            store.merge(batch_id)
            store.add(insert_new_articles(none, rows, ("published_at",)), batch_id)
            if then:
                then(valid, store, batch_id)

    query = (
        source.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return len(taken)


def stream_company_news(
    spark: SparkSession, feed_dir: str, table_dir: str, checkpoint: str, stocks: DataFrame, newest: KeptNewest, files_per_batch: int = 1000
) -> int:
    """Company news (with a ticker) as a stream: articles and rejects as in ``stream_ingest``, each new
    link in a folder of its batch, and the newest articles of each stock kept up to date.

    A link takes the time of the stored article, whichever batch stored it. Links may repeat between
    batches, as attempts do; ``read_links`` gives each once.
    """
    def link(batch: DataFrame, store: ArticleStore, batch_id: int) -> None:
        # urls are moved, not ids, which are hashes of them and do not pack
        pairs = batch.select("ticker", "url").join(stocks.select("ticker", "stock_id"), "ticker").select("url", "stock_id")
        stored = store.near(batch).select("url", "article_id", "published_at")
        linked = written(pairs.repartition("url").distinct().join(stored, "url"), "linked")
        put(with_ids(linked).select("article_id", "stock_id"), f"{table_dir}/links/batch={batch_id}", mode="overwrite")
        newest.update(with_ids(linked.repartition("stock_id")), batch_id)

    return stream_ingest(spark, feed_dir, table_dir, checkpoint, files_per_batch, more="ticker string", then=link)


def read_links(spark: SparkSession, table_dir: str, ddl: str = "article_id string, stock_id string") -> DataFrame:
    return spark.read.schema(f"{ddl}, batch long").parquet(f"{table_dir}/links").drop("batch").distinct()


def stream_readings(spark: SparkSession, feed_dir: str, checkpoint: str, kept: KeptNewest, files_per_batch: int = 1000) -> None:
    """Readings that land as Parquet files, kept as each stock's last ones."""
    source = spark.readStream.schema(kept.ddl).option("maxFilesPerTrigger", files_per_batch).parquet(feed_dir)
    query = source.writeStream.foreachBatch(kept.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_articles(spark: SparkSession, table_dir: str) -> DataFrame:
    """The article table; empty before the first batch."""
    return ArticleStore(spark, table_dir).read()


def read_rejects(spark: SparkSession, table_dir: str) -> DataFrame:
    """(stage, key, message) of all batches."""
    return spark.read.schema("stage string, key string, message string, batch long").parquet(f"{table_dir}/rejects").drop("batch")
