"""Headline search without a scan: postings of three-letter pieces, in files by piece.

``postings`` holds (gram, article_id) for each different piece of three characters of the lower-case
headline, sorted by piece in folders by a hash of it; ``counts`` how many articles have a piece;
``headlines`` the articles in folders by a hash of their id. A search asks for the rarest pieces of its
text, meets their postings, and opens only the headlines that are left; these it looks at. Common
pieces are spread over files by article, and are asked only where a text has no rarer ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE, ASKED = 3, 3


def _bucket(c: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def pieces(text: Column) -> Column:
    """The different pieces of a text; none for a shorter one, or null."""
    places = F.when(F.length(text) >= SIZE, F.sequence(F.lit(1), F.length(text) - SIZE + 1))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(SIZE))))


class HeadlineIndex:
    """``find`` gives what a scan by ``scope.headline_contains`` would, for the articles of ``build``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        #: Folders of headlines that the last ``find`` opened.
        self.opened = buckets

    def build(self, articles: DataFrame) -> HeadlineIndex:
        """Index ``articles`` (article_id, headline); other columns play no part."""
        own = articles.select("article_id", "headline")
        own.withColumn("bucket", _bucket("article_id", self.buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/headlines")
        held = self.spark.read.parquet(f"{self.path}/headlines")
        grams = held.select(F.explode(pieces(F.lower("headline"))).alias("gram"), "article_id").withColumn("bucket", _bucket("gram", self.buckets))
        ranged = grams.repartitionByRange("bucket", "gram", "article_id").sortWithinPartitions("bucket", "gram", "article_id")
        ranged.write.partitionBy("bucket").option("parquet.bloom.filter.enabled#gram", "true").parquet(f"{self.path}/postings")
        counted = self.spark.read.parquet(f"{self.path}/postings").groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("n"))
        counted.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/counts")
        return self

    def _read(self, name: str, buckets: list[int]) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("bucket").isin(buckets)).drop("bucket")

    def candidates(self, text: str) -> DataFrame | None:
        """(article_id) of the articles with the rarest pieces of ``text`` in them; None if it has none."""
        grams = sorted({text[i : i + SIZE] for i in range(len(text) - SIZE + 1)})
        if not grams:
            return None
        asked = self.spark.createDataFrame([(g,) for g in grams], "gram string").withColumn("bucket", _bucket("gram", self.buckets))
        place = {r["gram"]: r["bucket"] for r in asked.collect()}
        known = self._read("counts", sorted(set(place.values()))).where(F.col("gram").isin(grams)).collect()  # one row a piece of the text
        rare = sorted(known, key=lambda r: (r["n"], r["gram"]))[:ASKED] if len(known) == len(grams) else []
        names = [r["gram"] for r in rare]
        postings = self._read("postings", sorted({place[g] for g in names})).where(F.col("gram").isin(names))
        return postings.groupBy("article_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == max(1, len(names))).select("article_id")

    def find(self, query: str | None) -> DataFrame:
        """(article_id, headline) of the articles whose headline has the trimmed text in it, in any case.
        A text of fewer than three characters is looked for in all."""
        text = (query or "").strip().lower()
        found = self.candidates(text)
        if found is None:
            self.opened = self.buckets
            held = self.spark.read.parquet(f"{self.path}/headlines").drop("bucket")
            return held.where(F.lower("headline").contains(text))
        found = found.withColumn("bucket", _bucket("article_id", self.buckets)).persist()
        buckets = [r["bucket"] for r in found.select("bucket").distinct().collect()]  # bounded by the number of folders
        self.opened = len(buckets)
        held = self._read("headlines", buckets).join(found.select("article_id"), "article_id", "left_semi")
        return held.where(F.lower("headline").contains(text))
