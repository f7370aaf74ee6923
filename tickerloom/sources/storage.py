"""Where jobs put what executors must share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path under ``spark.checkpoint.dir``; only where a local session has none, under a local
    folder. On a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tickerloom-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, Spark removes a finished write's shuffle files: the table is all that is needed."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: The tables that each open ``scratch`` block removes at its end.
_OPEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within, tables that ``written`` makes are removed at the end of the block, but for those it is
    told to keep; these go with the next block around, if there is one."""
    own: list[str] = []
    _OPEN.append(own)
    try:
        yield
    finally:
        _OPEN.pop()
        for path in own:
            remove(spark, path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path like ``shared_path``; what is put there is removed with the tables of the ``scratch`` block."""
    path = shared_path(spark, label)
    for own in _OPEN[-1:]:
        own.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def files_in(spark: SparkSession, path: str) -> list[str]:
    """The data files right in a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return [str(s.getPath()) for s in found if s.getPath().getName()[:1] not in "_."]


def put(df: DataFrame, path: str, *folders: str, mode: str = "errorifexists") -> None:
    """Write a Parquet folder, packed tightly, and leave no shuffle files behind."""
    out = df.write.mode(mode).option("compression", "zstd")
    with tidy_shuffles(df.sparkSession):
        (out.partitionBy(*folders) if folders else out).parquet(path)


def written_and_counted(df: DataFrame, label: str, keep: bool = False) -> tuple[DataFrame, int]:
    """``written``, and the number of rows, seen as they were written: no job counts them again."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")), label, keep)
    return out, seen.get["n"]


def written(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """A frame written to the shared folder and read back: computed once, however often it is used."""
    path = shared_path(df.sparkSession, label)
    for own in _OPEN[-1 - keep : len(_OPEN) - keep]:
        own.append(path)
    put(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
