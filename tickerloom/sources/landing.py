"""Landed feed files with what could not be read of them: no file, line or request stops the others.

A fetcher writes its responses as JSON lines. A request that failed lands too, as a record with
``error`` and what was asked for. A line that is no JSON is kept by its text, and a file that cannot be
read through is named in a ledger of files and left out whole.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .feeds import arrival
from .storage import written

REJECTS = "stage string, key string, message string"
LEDGER = "file string, bytes long, fault string"


@dataclass
class Landed:
    """``rows`` of a feed, None if it could not be had, and ``rejects`` (stage, key, message)."""

    rows: DataFrame | None
    rejects: DataFrame


def file_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, fault) of every file under ``path``. The fault of a compressed file that does not
    hold what it should is ``the file is cut short`` or ``the file is not gzip``; others have none.

    Files are listed by Spark and looked through by tasks; only the compressed ones are opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    plain = files.load(path).where(~F.col("path").endswith(".gz"))
    plain = plain.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.lit(None).cast("string").alias("fault"))
    # by the name alone: a condition on rows would read the files that it leaves out
    return plain.unionByName(files.option("pathGlobFilter", "*.gz").load(path).select("path", "length", "content").mapInArrow(_look, LEDGER))


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        faults = pa.array([_fault(c.as_buffer()) for c in b.column("content")], pa.string())
        yield pa.RecordBatch.from_arrays([b.column("path"), b.column("length"), faults], names=["file", "bytes", "fault"])


def _fault(content: pa.Buffer) -> str | None:
    try:
        with gzip.open(pa.BufferReader(content)) as f:
            while f.read(1 << 20):
                pass
    except EOFError:
        return "the file is cut short"
    except (OSError, zlib.error):
        return "the file is not gzip"
    return None


def _broken(spark: SparkSession, path: str, feed: str) -> DataFrame:
    """The files with a fault, looked through once; of compressed files a task sends one at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        return written(file_ledger(spark, path).where("fault is not null"), f"{feed}-broken", keep=True)
    finally:
        spark.conf.set(name, before)


def read_landed(spark: SparkSession, path: str, ddl: str, feed: str, key: str) -> Landed:
    """The records under ``path`` with ``pos``, and rejects: failed requests by the column ``key`` of
    ``ddl``, lines that are no JSON by their text, broken files by their path, and a path that is not
    there by the reason. What is read is written, so the files are not needed any more."""
    try:
        raw = spark.read.schema(f"{ddl}, error string, {schemas.CORRUPT} string")
        raw = raw.option("columnNameOfCorruptRecord", schemas.CORRUPT).option("ignoreCorruptFiles", "true").json(path)
        broken = _broken(spark, path, feed)
    except AnalysisException as e:
        return Landed(None, spark.createDataFrame([(feed, None, str(e).splitlines()[0])], REJECTS))
    raw = raw.withColumn("pos", arrival())
    whole = written(raw.join(broken.select("file"), F.col("pos.file") == F.col("file"), "left_anti"), f"{feed}-records", keep=True)
    stage = F.lit(feed).alias("stage")
    failed = whole.where(F.col("error").isNotNull()).select(stage, F.col(key).cast("string").alias("key"), F.col("error").alias("message"))
    torn = whole.where(F.col(schemas.CORRUPT).isNotNull()).select(stage, F.col(schemas.CORRUPT).alias("key"), F.lit("no JSON").alias("message"))
    lost = broken.select(stage, F.col("file").alias("key"), F.col("fault").alias("message"))
    rows = whole.where(F.col("error").isNull() & F.col(schemas.CORRUPT).isNull()).drop("error", schemas.CORRUPT)
    return Landed(rows, failed.unionByName(torn).unionByName(lost))


def land_general(spark: SparkSession, path: str, category: str = "general") -> Landed:
    """General news of one category."""
    got = read_landed(spark, path, schemas.NEWS, "general", "category")
    return Landed(got.rows.where(F.col("category") == category), got.rejects) if got.rows is not None else got


def land_company(spark: SparkSession, path: str) -> Landed:
    """Company news; a request that failed is known by its ticker."""
    return read_landed(spark, path, f"{schemas.NEWS}, ticker string", "company", "ticker")


def land_tagged(spark: SparkSession, path: str) -> Landed:
    """Tagged news, an article a row, with the ``batch`` of symbols that its request asked for."""
    got = read_landed(spark, path, f"{schemas.TAGGED}, batch long", "tagged", "batch")
    if got.rows is None:
        return got
    return Landed(got.rows.select(F.explode("data").alias("a"), "batch", "pos").select("a.*", "batch", "pos"), got.rejects)
