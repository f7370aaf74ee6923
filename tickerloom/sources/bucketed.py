"""Tables that many queries join by stock, stored so that the joins need no shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``df`` as a table in the warehouse, hashed by ``key`` into ``buckets`` buckets, each sorted. Joins
    and aggregates by ``key`` of tables with as many buckets read them in place."""
    spark, table = df.sparkSession, f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return spark.table(table)
