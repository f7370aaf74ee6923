"""The newest rows of each key, kept up to date batch by batch."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.rank import top_k_per_group
from ..sources.storage import put, remove, scratch, written


class KeptNewest:
    """A table of the first ``k`` rows of each key, in place of a window over all history.

    The first k of what was kept and what comes are the first k of all, so batches may come in any
    order, late and repeated rows included; rows are told apart by all their columns. Keys lie in
    hash buckets; a batch reads and writes only the buckets of its keys, as a folder of its own,
    and a bucket's newest complete folder counts. A batch that is run again starts from what was
    kept before it, so a failure halfway neither doubles nor loses rows.
    """

    def __init__(self, spark: SparkSession, path: str, ddl: str, key: str, order: list[tuple[str, bool]], k: int, buckets: int = 16):
        """``order``: columns, each with whether the greatest is first; they must tell rows of a key apart."""
        self.spark, self.path, self.ddl, self.key, self.k, self.buckets = spark, path.rstrip("/"), ddl, key, k, buckets
        self.order = [F.desc(c) if falling else F.asc(c) for c, falling in order]

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _numbers(self, path: str, name: str) -> list[int]:
        fs, at = self._fs(path)
        found = [re.fullmatch(rf"{name}=(\d+)", s.getPath().getName()) for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(m[1]) for m in found if m)

    def _places(self, before: int | None) -> dict[int, int]:
        """The newest complete batch of each bucket."""
        out = {}
        for batch in self._numbers(self.path, "batch"):
            fs, at = self._fs(f"{self.path}/batch={batch}/_SUCCESS")
            if (before is None or batch < before) and fs.exists(at):
                out |= {b: batch for b in self._numbers(f"{self.path}/batch={batch}", "bucket")}
        return out

    def read(self, before: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The kept rows with their ``rank`` from 1; of some buckets only, no other is opened."""
        at = {b: n for b, n in self._places(before).items() if buckets is None or b in buckets}
        if not at:
            return self.spark.createDataFrame([], f"{self.ddl}, rank int")
        paths = [f"{self.path}/batch={n}/bucket={b}" for b, n in sorted(at.items())]
        return self.spark.read.schema(f"{self.ddl}, rank int").parquet(*paths)

    def update(self, rows: DataFrame, batch_id: int) -> None:
        """Take in rows with the table's columns; those without a key are left out."""
        own = [x.split()[0] for x in self.ddl.split(", ")]
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        # a row that comes twice has one dense rank, so rows are told apart after the cut
        place = F.dense_rank().over(W.partitionBy(self.key).orderBy(*self.order))
        cut = rows.select(*own).where(F.col(self.key).isNotNull()).withColumn("rank", place).where(F.col("rank") <= self.k)
        with scratch(self.spark):
            fresh = written(cut.drop("rank").distinct(), "fresh")
            touched = {r[0] for r in fresh.select(bucket).distinct().collect()}  # no more than there are buckets
            kept = self.read(batch_id, touched).drop("rank")
            merged = top_k_per_group(kept.unionByName(fresh).distinct(), [self.key], self.order, self.k)
            put(merged.withColumn("bucket", bucket).repartition("bucket"), f"{self.path}/batch={batch_id}", "bucket", mode="overwrite")
        live = set(self._places(batch_id).values())
        for batch in self._numbers(self.path, "batch"):
            if batch < batch_id and batch not in live:  # what a run again of this batch starts from stays
                remove(self.spark, f"{self.path}/batch={batch}")


def kept_readings(spark: SparkSession, path: str, k: int = 30, key: str = "string") -> KeptNewest:
    """The last ``k`` readings of each stock; those of rank 1 are the latest."""
    return KeptNewest(spark, path, f"stock_id {key}, sentiment_id {key}, score double, date timestamp", "stock_id", [("date", True), ("sentiment_id", False)], k)


def kept_articles(spark: SparkSession, path: str, k: int = 20, key: str = "string") -> KeptNewest:
    """The newest ``k`` articles of each stock."""
    return KeptNewest(spark, path, f"stock_id {key}, article_id string, published_at timestamp", "stock_id", [("published_at", True), ("article_id", False)], k)
