"""A training-corpus pipeline: language ID, near-dedup, decontamination, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage as
Parquet to the shared folder and reads it again as the next stage's input. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.common import materialise, table
from tickerloom.llm.op02_decontamination import contaminated
from tickerloom.llm.op03_language import learnable, train, with_known_language
from tickerloom.llm.op05_secrets import RuleSet, scan_secrets
from tickerloom.llm.op09_packing import pack, pieces
from tickerloom.llm.resemblance import content, one_of_each, rows_of

#: A language is taken for known if every duel it won was won this clearly.
LEAST_SURE = 0.5

#: What stands for a secret in the kept text.
MASK = "[secret]"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; ``lang`` becomes the predicted one.

    Rejected: no letter, null text, or a duel lost, of families or of languages (a score under
    ``LEAST_SURE``). Each row is judged by itself, so repeated rows and null ids are judged alike.
    Where no row is labelled nothing is known, and an empty table gives an empty one. A very long
    text is judged whole.
    """
    return with_known_language(docs, train(learnable(docs)), LEAST_SURE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id.

    Documents are linked where their sets of five-word shingles have a Jaccard similarity of 0.8
    or more; SimHash groups (operator 6, five-word shingles) are compared first, and parity sketches
    find the rest. Of rows with one
    doc_id one stays, whichever columns differ, chosen by content. A row with a null doc_id stays
    only where its group has no other, and then one does. Texts without words are one group, a null
    text among them. A very long text is taken whole; an empty table gives an empty one.
    """
    return rows_of(docs, one_of_each(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Texts are judged, not ids, so repeated and null ids are
    judged like any other; a null or empty text stays. A very long text is looked through whole; an
    empty table, or an empty benchmark, takes nothing away."""
    texts = docs.select(content(F.col("text")).alias("doc_id"), "text")
    hits = contaminated(texts, table(spark, sf_dir, "benchmark"))
    flagged = materialise(hits.select(F.col("doc_id").alias("__id")).distinct(), "contaminated")
    return docs.join(flagged, content(F.col("text")) == F.col("__id"), "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in them replaced by ``MASK``; n_chars follows the text.

    Overlapping spans are masked as one. Findings come from the ledger by content, so equal texts
    are masked alike, whatever their ids. Null and empty texts stay as they are; a very long text is
    scanned whole; an empty table gives an empty one.
    """
    rules = RuleSet()
    found = scan_secrets(docs, "doc_id", "text", rules=rules).where(F.size("findings") > 0)
    # 128 bits of the blob's address and bare spans: the table stays small enough to broadcast long
    address = lambda c: F.unhex(F.substring(c, 1, 32))
    bare = F.transform("findings", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    spans = materialise(
        found.select(address("blob_id").alias("__b"), bare.alias("__spans")).dropDuplicates(["__b"]), "secret-spans"
    )
    blob = address(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    joined = docs.withColumn("__blob", blob).join(spans, F.col("__blob") == F.col("__b"), "left")
    ordered = F.array_sort("__spans")
    # what is kept so far, and where the next piece begins
    walk = F.aggregate(
        ordered,
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda acc, x: F.struct(
            F.when(
                x["start"] >= acc["at"],
                F.concat(acc["done"], F.substring("text", acc["at"] + 1, x["start"] - acc["at"]), F.lit(MASK)),
            ).otherwise(acc["done"]).alias("done"),
            F.greatest(acc["at"], x["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["done"], F.substring("text", acc["at"] + 1, F.length("text"))),
    )
    masked = joined.withColumn("text", F.when(F.col("__spans").isNotNull(), walk).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("__spans").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, packed into sequences of 2048 tokens. A null text is a piece of
    the end token alone; repeated rows and null ids are packed each; an empty table gives no rows."""
    return pack(materialise(pieces(docs), "pieces")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", mask_secrets),
    ("best-fit packing", packed),
]

#: Fingerprints, learned languages, automata and token ids are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
