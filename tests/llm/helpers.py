"""Small tables with every awkward case, and brute-force versions."""

from __future__ import annotations

import pandas as pd

LONG = "lorem ipsum dolor " * 20_000

AWKWARD = [
    (1, None, "en", None),
    (2, "", None, "s"),
    (3, "   \t\n", "en", "s"),
    (4, "same text of a few words here", "en", "s"),
    (5, "same text of a few words here", "en", "s"),
    (5, "same text of a few words here", "en", "s"),
    (6, LONG, "en", "s"),
    (7, "12345 %%% ###", "de", None),
    (None, "no id at all in this row", "en", "s"),
    (8, "\u0000  odd <|endoftext|> é x", None, None),
]


def frame(spark, rows=AWKWARD, extra=True):
    """documents with columns that clash with the operators' own names."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    if extra:
        from pyspark.sql import functions as F

        for c in ("shard", "slot", "fp", "component_id", "score", "findings", "path", "piece", "length", "rank", "words", "item", "h", "train", "n_chars"):
            df = df.withColumn(c, F.lit(1))
    return df


def documents(sf) -> pd.DataFrame:
    return pd.read_parquet(f"{sf}/documents.parquet")


def words(text):
    return (text or "").encode().lower().split()
