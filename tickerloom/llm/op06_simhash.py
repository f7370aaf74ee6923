"""SimHash near-duplicates by a forest of vantage-point trees.

Two fingerprints that differ in at most ``distance`` of 64 bits differ in at most
``distance // blocks`` bits of one of ``blocks`` bit blocks. So there is one vantage-point tree
for each block: it partitions fingerprints by their Hamming distance to vantage points within the
block. Each fingerprint lives in one shard of each tree. Its search ball, of that small radius,
goes down both sides of a node where the triangle bound excludes neither, and asks every shard it
can meet. Inside a shard whole fingerprints are compared, so the pairs are exact, with no recall
to measure.

Production takes three blocks of 21 or 22 bits and radius 1. One tree over all 64 bits
(``blocks=1``) is the same code; there distances crowd around 32, so that a ball of radius 4 meets
most shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, materialise, scratch, table
from .graph import connected_components

SEED, SHINGLE, DISTANCE = 42, 4, 4
SAMPLE, DEEPEST = (1 << 13, 1 << 17), 18
_STEP = 1 << 14  # shingles whose bits are counted at a time


def shingle_hashes(text: str, n: int = SHINGLE) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    cuts = [line[a:b] for a, b in zip(starts[: 1 - n].tolist(), ends[n - 1 :].tolist(), strict=True)]
    return np.fromiter(map(xxhash.xxh64_intdigest, cuts, repeat(SEED)), np.uint64, len(cuts))


def simhash(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes; no hashes: 0. Unsigned."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _STEP):
        part = np.ascontiguousarray(hashes[i : i + _STEP]).view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long. A null text is an empty one."""

    def rows(batch: pa.RecordBatch) -> dict[str, list]:
        fps = np.array([simhash(shingle_hashes(t.as_py() or "", shingle)) for t in batch.column("text")], np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": fps.view(np.int64)}

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, fp long", rows)


def block_masks(blocks: int) -> list[int]:
    edges = np.linspace(0, 64, blocks + 1).round().astype(int).tolist()
    return [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]


@dataclass
class VPTree:
    """A complete binary tree in heap order; a node sends ``distance <= radius`` to the left."""

    mask: np.uint64
    points: np.ndarray
    radii: np.ndarray
    depth: int

    @classmethod
    def fit(cls, sample: np.ndarray, mask: int, depth: int) -> VPTree:
        """Vantage points and median radii from a sample; any sample gives exact results."""
        nodes = (1 << depth) - 1
        points, radii = np.zeros(nodes, np.uint64), np.full(nodes, 64, np.int64)
        members = {0: np.unique(sample & np.uint64(mask))}
        for i in range(nodes):
            own = members.pop(i, sample[:0])
            if len(own):
                tries = own[np.linspace(0, len(own) - 1, min(8, len(own))).astype(int)]
                far = np.bitwise_count(tries[:, None] ^ own[None, :]).astype(np.int64)
                best = int(far.var(axis=1).argmax())  # spreads its members most
                cut = int(np.median(far[best]))
                if (far[best] <= cut).all():
                    cut -= 1
                points[i], radii[i] = tries[best], cut
                left = far[best] <= cut
                if 2 * i + 2 < nodes:
                    members[2 * i + 1], members[2 * i + 2] = own[left], own[~left]
        return cls(np.uint64(mask), points, radii, depth)

    def shards(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for each leaf that a ball of ``radius`` around each fingerprint can meet;
        with radius 0 the one leaf where each lives."""
        row, node = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        for _ in range(self.depth):
            d = np.bitwise_count((fps[row] ^ self.points[node]) & self.mask).astype(np.int64)
            left, right = d - radius <= self.radii[node], d + radius > self.radii[node]
            row = np.concatenate((row[left], row[right]))
            node = np.concatenate((2 * node[left] + 1, 2 * node[right] + 2))
        return row, node


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after nodes a[i] and b[i] are linked: the least node of what is linked so far."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        up = np.arange(len(label))
        np.minimum.at(up, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (up[up] != up).any():
            up = up[up]
        label = up[label]


def local_links(homes: np.ndarray, asked: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, least of its group) that join all that the pairs of ``homes`` and
    ``asked`` within ``distance`` bits link.

    A group of n copies gives n - 1 edges, and memory is a slice of the distances, never all pairs.
    """
    nodes = np.unique(np.concatenate((homes, asked)))
    home, label = np.searchsorted(nodes, homes), np.arange(len(nodes))
    for i in range(0, len(asked), 256):
        own = asked[i : i + 256]
        row, col = np.nonzero(np.bitwise_count(own[:, None] ^ homes[None, :]) <= distance)
        label = _joined(label, np.searchsorted(nodes, own)[row], home[col])
    linked = label != np.arange(len(nodes))
    return nodes[linked], nodes[label[linked]]


def near_pairs(
    fps: DataFrame, distance: int = DISTANCE, blocks: int = 3, leaf: int = 512, cell: int = 2048
) -> DataFrame:
    """Edges (src, dst) that connect all fingerprints within ``distance`` bits of each other.

    ``fps`` has one column fp of distinct signed longs. Trees are fitted on a sample of a 64th of the
    fingerprints (``SAMPLE``: at least 2**13, at most 2**17), deep enough for ``leaf`` of them in a shard
    (bounded by 2**``DEEPEST`` shards a tree, of 16 bytes each when broadcast). Where more than ``cell`` fingerprints live in a shard or ask it, say those
    of a huge family of near copies, both sides are cut into slices, and every pair of slices is
    a task's cell, so no task holds more than about two slices and no pair is lost.
    """
    spark = fps.sparkSession
    n = fps.count()
    if n < 2:
        return spark.createDataFrame([], "src long, dst long")
    drawn = fps.orderBy(F.xxhash64("fp"), "fp").limit(int(np.clip(n >> 6, *SAMPLE))).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    depth = int(np.clip(np.ceil(np.log2(max(1, n / leaf))), 0, DEEPEST))
    trees = [VPTree.fit(drawn, m, depth) for m in block_masks(blocks)]
    forest, radius = spark.sparkContext.broadcast(trees), distance // blocks

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column("fp"), np.int64)
            for k, tree in enumerate(forest.value):
                for asks, reach in ((False, 0), (True, radius)):
                    row, node = tree.shards(own.view(np.uint64), reach)
                    yield pa.RecordBatch.from_pydict(
                        {"tree": np.full(len(row), k, np.int32), "leaf": node, "asks": np.full(len(row), asks), "fp": own[row]}
                    )

    routed = fps.mapInArrow(route, "tree int, leaf long, asks boolean, fp long")
    # at most blocks * 2**DEEPEST rows
    slices = lambda asks: F.ceil(F.count_if(F.col("asks") == asks) / cell).cast("int")
    sizes = routed.groupBy("tree", "leaf").agg(slices(False).alias("homes"), slices(True).alias("askers")).where("homes > 0 and askers > 0")
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("asks"), F.col("askers")).otherwise(F.col("homes"))).cast("int")
    cells = (
        routed.join(F.broadcast(sizes), ["tree", "leaf"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("asks"), F.col("homes")).otherwise(F.col("askers")) - 1)))
        .select(
            "tree", "leaf", F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")).alias("a"),
            F.when(F.col("asks"), F.col("own")).otherwise(F.col("other")).alias("b"), "asks", "fp",
        )
    )

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        own, asks = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["asks"].to_numpy(bool)
        src, dst = local_links(own[~asks], own[asks], distance)
        return pd.DataFrame({"src": src.view(np.int64), "dst": dst.view(np.int64)})

    return cells.groupBy("tree", "leaf", "a", "b").applyInPandas(links, "src long, dst long").distinct()


def near_fingerprints(fps: DataFrame, distance: int = DISTANCE, blocks: int = 3) -> DataFrame:
    """(fp, root) for each distinct fingerprint of ``fps`` (fp): those that links of at most
    ``distance`` bits join have one root, the least of them as a signed number."""
    groups = connected_components(near_pairs(fps, distance, blocks))
    return fps.join(groups, fps["fp"] == groups["node"], "left").select("fp", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, blocks: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text).

    component_id is the least doc_id reachable over links of at most ``distance`` bits. Copies
    share a fingerprint and meet in a ``min``; only different fingerprints are compared. Null
    and empty texts have fingerprint 0. A null doc_id keeps its row and never names a
    component unless no other does. A very long text is hashed whole, its bits counted in steps.
    Other columns play no part; an empty table gives no rows.
    """
    with scratch(docs.sparkSession):
        marked = materialise(fingerprints(docs, shingle), "simhash", keep=True)
        least = marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
        distinct = materialise(least, "simhash-distinct")
        roots = near_fingerprints(distinct.select("fp"), distance, blocks)
        labelled = materialise(distinct.join(roots, "fp").select("fp", "root", "least_id"), "simhash-groups")
        # written, so that both sides of the join are plain and a huge family's partition can be split
        least_of_group = materialise(labelled.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash-heads")
        named = materialise(labelled.join(least_of_group, "root").select("fp", "component_id"), "simhash-components", keep=True)
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def op6_simhash_vp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
