"""Near copies: SimHash groups first, then whatever else has similar sets of word shingles.

A link needs a Jaccard similarity of the two shingle sets; bits only propose it. SimHash groups
(operator 6) are compared with one of them first; what they do not join is found by parity sketches
(operator 13), which lose no link.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch
from .op06_simhash import near_fingerprints
from .op13_parity import SIMILARITY, WORDS, content, keyed_sets, similar_sets


def _others(docs: DataFrame) -> Column:
    """A hash of all columns but doc_id and text."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in sorted(docs.columns) if c not in ("doc_id", "text")], F.lit(0))


def likely_pairs(named: DataFrame) -> DataFrame:
    """(src, dst): the sets of ``named`` (name, fp) whose SimHashes lie in one group, with the least of them."""
    roots = near_fingerprints(materialise(named.select("fp").distinct(), "set-fingerprints"))
    groups = materialise(named.join(roots, "fp").select("name", "root"), "simhash-groups")
    least = groups.groupBy("root").agg(F.min("name").alias("src"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return groups.join(least, "root").where("name <> src").select("src", F.col("name").alias("dst"))


def one_of_each(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, c, rest, copies): one row of ``docs`` for each group of near copies, named by its
    id, its content and a hash of its other columns, and how many rows have that name.

    The row with the least doc_id stands for its group, of rows with one id the one with the least
    hashes; one without doc_id only where there is no other. Texts without words are one group. A very
    long text is taken whole; an empty table gives no rows.
    """
    with scratch(docs.sparkSession):
        asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content(F.col("text")).alias("c"), _others(docs).alias("rest"), "text")
        keyed = materialise(keyed_sets(asked, words, similarity, with_simhash=True), "keyed-sets")
        own = keyed.where("own")
        sets = materialise(own.groupBy("name").agg(F.min("fp").alias("fp")), "sets")
        groups = similar_sets(docs, keyed, words, similarity, materialise(likely_pairs(sets), "likely"))
        row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "c", "rest")
        best = own.groupBy("name", row.alias("r")).agg(F.count(F.lit(1)).alias("copies")).groupBy("name").agg(F.min(F.struct("r", "copies")).alias("r"))
        best = materialise(best.join(groups, "name", "left"), "best-of-sets")
        heads = best.where("root is null").select("r").unionByName(best.where("root is not null").groupBy("root").agg(F.min("r").alias("r")).select("r"))
        return materialise(heads.select("r.r.doc_id", "r.r.c", "r.r.rest", "r.copies"), "heads", keep=True)


def rows_of(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``one_of_each`` names, each once, with all columns.

    Texts move once at most; only rows that are repeated whole are told apart by a shuffle.
    """
    key = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 63)))
    marked = docs.withColumn("__key", key("doc_id")).withColumn("__c", content(F.col("text"))).withColumn("__rest", _others(docs))
    named = heads.select(key("doc_id").alias("__key"), F.col("c").alias("__c"), F.col("rest").alias("__rest"), "copies")
    on = ["__key", "__c", "__rest"]
    single = marked.join(named.where("copies = 1"), on, "left_semi")
    many = marked.join(named.where("copies > 1"), on, "left_semi").dropDuplicates(on)
    return single.unionByName(many).select(*[F.col(f"`{c}`") for c in docs.columns])
