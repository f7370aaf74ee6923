"""Distributed connected components, shared by near-dedup and URL filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch


def connected_components(edges: DataFrame, salts: int = 8) -> DataFrame:
    """Components of an undirected graph as ``(node, component)``, component = least node.

    ``edges`` has columns ``src`` and ``dst`` of one orderable type. Nulls and self loops are
    ignored, repeated edges count once, a node without another node is not returned, and an
    empty table gives an empty result.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): every step is a
    ``min`` with map-side combine, then one equi-join of the edges with those minima. A hub
    would send its whole star to one join task, so the edges carry ``salts`` salts and the
    minima are repeated once for each. Rounds go on until every node but the least of its component
    has one edge, to that; their number grows with the logarithm of the longest chain, and edges that
    come as such stars take none. Each round's edges are written to the shared folder,
    and removed once the last are; the driver sees one number a round.
    """
    spark = edges.sparkSession
    pairs = edges.where("src <> dst").select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    )
    with scratch(spark):
        current = materialise(pairs.distinct(), "cc")
        while _unsettled(current):
            current = materialise(_small_star(_large_star(current, salts), salts), "cc")
        members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        hubs = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        return materialise(members.unionByName(hubs), "components", keep=True)


def _unsettled(df: DataFrame) -> int:
    """How many nodes ``u`` have several edges, or are some other node's ``v``: without any,
    each component is a star around its least node, as ``u`` is always the greater one."""
    ends = df.select(F.inline(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")),
    )))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.count_if((F.col("up") > 0) & (F.col("up") + F.col("down") > 1)).alias("n")).first()["n"]


def _with_min(df: DataFrame, salts: int) -> DataFrame:
    """Add ``m``, the least of a node ``u`` and its neighbours ``v``."""
    least = df.groupBy("u").agg(F.min("v").alias("least_v")).select(
        "u",
        F.least("u", "least_v").alias("m"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
    )
    return df.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(
        least, ["u", "salt"]
    )


def _large_star(df: DataFrame, salts: int) -> DataFrame:
    both = df.unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        _with_min(both, salts)
        .where("v > u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(df: DataFrame, salts: int) -> DataFrame:
    return (
        _with_min(df, salts)
        .select(F.inline(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        .where("u <> v")
        .distinct()
    )
