"""Helpers shared by the training-data operators: shared storage, tables, text rules."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``.

    Only where a local session has none (tests, a laptop) is a local folder made and set; on a
    cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        made = spark.sparkContext.getCheckpointDir()
        if made:
            return made
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
        path = "file://" + tempfile.mkdtemp(prefix="tickerloom-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


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
    """Within, tables that ``materialise`` writes are removed at the end of the block, but for
    those it is told to keep; these go with the next block around, if there is one."""
    own: list[str] = []
    _OPEN.append(own)
    try:
        yield
    finally:
        _OPEN.pop()
        for path in own:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives the planner the true size, so
    that a later join broadcasts only what is under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    path = fresh_path(df.sparkSession, label)
    for own in _OPEN[-1 - keep : len(_OPEN) - keep]:
        own.append(path)
    with tidy_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def crc_bucket(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def map_arrow(
    df: DataFrame, schema: str, rows: Callable[[pa.RecordBatch], dict[str, list] | pa.RecordBatch], step: int | None = None
) -> DataFrame:
    """``mapInArrow`` over one batch, or ``step`` rows of it, at a time; ``rows`` gives the output columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step or max(1, whole.num_rows)):
                batch = whole.slice(at, step)
                cols = rows(batch)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[f.name], type=f.type) for f in out], schema=out
                )

    return df.mapInArrow(run, schema)
