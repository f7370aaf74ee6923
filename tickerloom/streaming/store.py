"""The article table of a stream: runs of url-hash buckets, a bitmap beside each bucket, merged by size.

A micro-batch adds one run. A run is a Parquet folder partitioned by ``bucket``, a hash of the url, with
about ``rows_per_bucket`` rows in a bucket, and beside each bucket a bitmap in which every url sets
``PROBES`` bits. A batch asks the bitmaps of the buckets its urls fall into, and opens only buckets
whose bitmap holds all bits of one of its urls; an exact anti join on those decides. So what a batch opens
follows the batch, not the table. An article whose id is the hash of its url is stored without it. Neighbouring runs of like size are merged when there are ``fan`` of
them, so there are few runs, and a row is rewritten once for each power of ``fan``.

A run's name says which batches it holds, and it counts once its bitmaps are complete. A run within
another's range is superseded. So a batch or a merge that failed halfway is not seen, and is made again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import put, remove, written, written_and_counted

ARTICLES = "url string, headline string, summary string, source string, published_at timestamp, article_id string"
MARKS = "bucket int, cell long, bits binary"
PROBES, BITS_A_ROW, CELL = 3, 16, 32768  # CELL: bits that bitmap_construct_agg holds
#: Urls of a batch for each bucket of a run from which its bitmaps are not asked: of so many, five have all bits by chance.
CROWDED = 1024


@dataclass(frozen=True)
class Run:
    """The rows of batches ``first`` to ``last``."""

    first: int
    last: int
    rows: int
    buckets: int

    @property
    def name(self) -> str:
        return f"run={self.first}-{self.last}-{self.rows}-{self.buckets}"

    @property
    def cells(self) -> int:
        """Bitmap cells of each bucket."""
        return max(1, -(-self.rows * BITS_A_ROW // (self.buckets * CELL)))

    def holds(self, other: Run) -> bool:
        return self != other and self.first <= other.first and other.last <= self.last


class ArticleStore:
    def __init__(self, spark: SparkSession, path: str, rows_per_bucket: int = 1 << 17, fan: int = 8):
        self.spark, self.path, self.rows_per_bucket, self.fan = spark, path.rstrip("/"), rows_per_bucket, fan
        #: Bitmap files and row files that the last ``find`` opened.
        self.opened = (0, 0)

    # ---- folders ----

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _remove(self, path: str) -> None:
        remove(self.spark, path)

    def _buckets(self, kind: str, run: Run) -> set[int]:
        found = (re.fullmatch(r"bucket=(\d+)", n) for n in self._names(f"{self.path}/{kind}/{run.name}"))
        return {int(m[1]) for m in found if m}

    def runs(self, before: int | None = None) -> list[Run]:
        """The complete runs of batches under ``before`` that no other holds, in order."""
        found = []
        for name in self._names(f"{self.path}/marks"):
            m = re.fullmatch(r"run=(\d+)-(\d+)-(\d+)-(\d+)", name)
            if m and (before is None or int(m[2]) < before) and "_SUCCESS" in self._names(f"{self.path}/marks/{name}"):
                found.append(Run(*map(int, m.groups())))
        return sorted((r for r in found if not any(o.holds(r) for o in found)), key=lambda r: r.first)

    # ---- reading ----

    def _read(self, run: Run, buckets: set[int] | None = None) -> DataFrame:
        """Rows of a run as they are stored; of some buckets only, no other is listed or opened."""
        at = f"{self.path}/rows/{run.name}"
        own = sorted(self._buckets("rows", run) & buckets) if buckets is not None else None
        paths = [at] if own is None else [f"{at}/bucket={b}" for b in own]
        if not paths or not self._buckets("rows", run):
            return self.spark.createDataFrame([], ARTICLES)
        return self.spark.read.schema(ARTICLES + ", bucket int").option("basePath", at).parquet(*paths).drop("bucket")

    def read(self, before: int | None = None) -> DataFrame:
        """The whole table."""
        out = self.spark.createDataFrame([], ARTICLES)
        for run in self.runs(before):
            out = out.unionByName(self._read(run))
        return with_ids(out)

    def _probes(self, urls: DataFrame, run: Run) -> DataFrame:
        """(url, bucket, cell, bit): the bits of each url in the run's bitmaps."""
        bit = lambda i: F.pmod(F.xxhash64("url", F.lit(i)), F.lit(run.cells * CELL))
        bits = urls.select("url", _bucket(run.buckets).alias("bucket"), F.explode(F.array(*[bit(i) for i in range(1, PROBES + 1)])).alias("bit"))
        return bits.select("url", "bucket", F.expr(f"bit div {CELL}").alias("cell"), F.pmod("bit", F.lit(CELL)).cast("int").alias("bit"))

    def near(self, batch: DataFrame, before: int | None = None) -> DataFrame:
        """All rows of the buckets that may hold a url of ``batch``, as they are stored: ``with_ids`` names them."""
        known, marks, files, urls = self.spark.createDataFrame([], ARTICLES), 0, 0, None
        runs = self.runs(before)
        n = batch.agg(F.approx_count_distinct("url")).first()[0] if runs else 0
        for run in runs:
            likely = self._buckets("rows", run)
            if n < CROWDED * run.buckets:
                urls = written(batch.select("url").distinct(), "batch-urls") if urls is None else urls
                touched = {r[0] for r in urls.select(_bucket(run.buckets)).distinct().collect()} & self._buckets("marks", run)
                if not touched:
                    continue
                at = f"{self.path}/marks/{run.name}"
                held = self.spark.read.schema(MARKS).option("basePath", at).parquet(*[f"{at}/bucket={b}" for b in sorted(touched)])
                byte = F.conv(F.hex(F.substring("bits", F.expr("bit div 8 + 1"), F.lit(1))), 16, 10).cast("int")
                is_set = F.expr("shiftright(byte, bit % 8) & 1") == 1
                hit = self._probes(urls, run).join(held, ["bucket", "cell"]).withColumn("byte", byte).where(is_set)
                full = hit.groupBy("url", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == PROBES)
                likely = {r[0] for r in full.select("bucket").distinct().collect()}  # no more than the run has buckets
                marks += len(touched)
            files += len(likely)
            if likely:
                known = known.unionByName(self._read(run, likely))
        self.opened = (marks, files)
        return known

    def find(self, batch: DataFrame, before: int | None = None) -> DataFrame:
        """The stored rows, of batches under ``before``, with a url of ``batch``."""
        return with_ids(self.near(batch, before).join(batch.select("url"), "url", "left_semi"))

    # ---- writing ----

    def _write(self, rows: DataFrame, first: int, last: int, n: int) -> Run:
        buckets = 1 << max(0, (n // self.rows_per_bucket).bit_length())
        run = Run(first, last, n, buckets)
        for kind in ("marks", "rows"):
            for name in self._names(f"{self.path}/{kind}"):
                if name.startswith(f"run={first}-{last}-"):  # of a try that failed
                    self._remove(f"{self.path}/{kind}/{name}")
        put(rows.withColumn("bucket", _bucket(buckets)).repartition("bucket"), f"{self.path}/rows/{run.name}", "bucket")
        spread = self._probes(self._read(run).select("url"), run).groupBy("bucket", "cell")
        marks = spread.agg(F.expr("bitmap_construct_agg(cast(bit as long))").alias("bits"))
        put(marks.repartition("bucket"), f"{self.path}/marks/{run.name}", "bucket")
        return run

    def add(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Store the rows of ``batch`` (one a url) that are new, as batch ``batch_id``; those are returned.

        A batch that is run again replaces what it had stored.
        """
        own = F.when(F.col("article_id") != _id(), F.col("article_id"))
        batch, n = written_and_counted(batch.withColumn("article_id", own), "batch-articles")
        if self.runs(batch_id):
            batch, n = written_and_counted(batch.join(self.near(batch, batch_id).select("url"), "url", "left_anti"), "new-articles")
        return with_ids(self._read(self._write(batch, batch_id, batch_id, n)))

    def merge(self, before: int) -> list[Run]:
        """Merge ``fan`` neighbouring runs of batches under ``before``, as often as there are so many of
        which none holds over half of the rows; superseded runs are removed."""
        made = []
        while True:
            runs = self.runs(before)
            windows = [runs[i : i + self.fan] for i in range(len(runs) - self.fan + 1)]
            own = next((w for w in windows if 2 * max(r.rows for r in w) <= max(sum(r.rows for r in w), 2 * self.rows_per_bucket)), None)
            if own is None:
                return made
            rows = self._read(own[0])
            for r in own[1:]:
                rows = rows.unionByName(self._read(r))
            made.append(self._write(rows, own[0].first, own[-1].last, sum(r.rows for r in own)))
            for r in own:
                for kind in ("marks", "rows"):
                    self._remove(f"{self.path}/{kind}/{r.name}")


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int")


def _id():
    return F.sha2("url", 256)


def with_ids(rows: DataFrame) -> DataFrame:
    """Rows with the ids that are stored as null, as they are the hash of the url."""
    return rows.withColumn("article_id", F.coalesce("article_id", _id()))
