"""N-gram Jaccard join by parity sketches.

A document's set of word shingles is XOR-hashed into a sketch: the shingles are dealt over m parts
by hash, and a part is the XOR of its shingles' hashes, which stands for the parities of a very
wide row of bits. A shingle that one of two sets has and the other has not changes one part, so the
sketches differ in at most as many parts as the sets in shingles; at similarity t that is at most
D = (1 - t) / (1 + t) * (|A| + |B|). Sets of one size band have sketches of one m > D, so by the
pigeonhole principle similar sets agree in m - D parts or more, and they meet in a join on (band,
part, value). Of these join keys a set needs only its D + 1 least frequent: among m - D keys that
two sets share, the rarest is one of these in both (parts without a shingle count as most frequent).
A key that no other set has needs no join at all, so most sets drop out: D + 1 such keys prove that
a set has no partner.

What meets is ruled out by narrow parity sketches (about one bit a shingle), whose Hamming distance
is a lower bound too, and what is left is compared by whole sets. Every number of a set grows with
its size; nothing is capped, so no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, materialise, scratch, table
from .graph import connected_components
from .op06_simhash import shingle_hashes, simhash
from .sieve import mixed, sieve, sifted

WORDS, SIMILARITY = 5, 0.8
_EPS = 1e-9  # 0.8 is not a binary fraction
_SMALL = 32  # sets up to this size have a part for each shingle
_WIDTH = 1.5  # of a size band
STEP = 256  # sets whose shingles or keys a task holds at a time
BUCKET = 1 << 20  # keys that are summed up at a time


def content(text: Column) -> Column:
    """128 bits that stand for a text; null is a text of its own."""
    return F.unhex(F.when(text.isNull(), F.md5(F.lit("null").cast("binary"))).otherwise(F.md5(F.concat(F.lit("t"), text).cast("binary"))))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    return np.unique(shingle_hashes(text or "", words))


def set_name(own: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return xxhash.xxh3_128_digest(own.tobytes())


def band_top(band: int) -> int:
    return int(_SMALL * _WIDTH**band)


def band_of(size: int) -> int:
    band = 0
    while band_top(band) < size:
        band += 1
    return band


def most_apart(both: int, similarity: float) -> int:
    """The most shingles that one of two sets has alone, if their sizes sum to ``both``."""
    t = Fraction(similarity).limit_denominator(10**6)
    return math.floor((1 - t) / (1 + t) * both)


def sketch(own: np.ndarray, band: int, apart: int, similarity: float) -> np.ndarray:
    """Join keys of a set's parts in a band. Parts without a shingle give none, unless the set
    has fewer than ``apart`` + 1 others."""
    if not band:
        part, value = np.zeros(len(own), np.uint64), own
    else:
        top = most_apart(2 * band_top(band), similarity)
        m = top + 1 + max(12, top // 8)
        part = own % np.uint64(m)
        order = np.argsort(part.astype(np.uint16 if m < 1 << 16 else np.uint32), kind="stable")
        part = part[order]
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        part, value = part[first], np.bitwise_xor.reduceat(own[order], first)
        if len(part) <= apart:
            rest = np.setdiff1d(np.arange(m, dtype=np.uint64), part)
            part, value = np.concatenate((part, rest)), np.concatenate((value, np.zeros(len(rest), np.uint64)))
    return mixed(value ^ mixed(part + (np.uint64(band) << np.uint64(40))))


def sketches(own: np.ndarray, similarity: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(band, most that a partner there differs in, join keys) for a set's own band and for the one
    in which it can be the smaller partner."""
    n = len(own)
    largest = math.floor(n / similarity + _EPS)
    for band in range(band_of(n), band_of(largest) + 1):
        apart = most_apart(n + min(largest, band_top(band)), similarity)
        yield band, apart, sketch(own, band, apart, similarity)


def parity_bits(own: np.ndarray) -> np.ndarray:
    """A power of two of longs with a bit or more for each shingle: bit h mod size is the parity of
    the shingles there, so two sets differ in at least as many shingles as bits."""
    longs = 1 << max(0, math.ceil(len(own) / 64) - 1).bit_length()
    odd = np.bincount((own % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def bits_apart(x: str, y: str) -> Column:
    """In how many places two sets' parity bits differ, the longer ones folded to the shorter."""

    def folded(a: str, b: str) -> Column:
        half = F.size(b)
        both = F.zip_with(F.slice(a, F.lit(1), half), F.slice(a, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(a) > half, both).otherwise(F.col(a))

    apart = F.zip_with(folded(x, y), folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(apart, F.lit(0), lambda total, k: total + k)


KEYED = "name binary, n int, fp long, own boolean, band int, apart int, bits array<long>, keys array<long>"


def keyed_sets(docs: DataFrame, words: int, similarity: float, with_simhash: bool = False) -> DataFrame:
    """The columns of ``docs`` but ``text``, and its set's name, size, parity bits and keys: a row for
    each of the set's bands, ``own`` in the first. fp is its SimHash, if asked for, or else 0. A set
    without a shingle has one row without keys, in band -1."""
    kept = [f for f in docs.schema if f.name != "text"]
    names = [x.split()[0] for x in KEYED.split(", ")]

    def rows(batch: pa.RecordBatch) -> dict[str, pa.Array | list]:
        out: dict[str, list] = {x: [] for x in names}
        at = []
        for i, text in enumerate(batch.column("text")):
            hashes = shingle_hashes(text.as_py() or "", words)
            own = np.unique(hashes)
            fp = int(np.uint64(simhash(hashes)).astype(np.int64)) if with_simhash else 0
            head, bits = (set_name(own), len(own), fp), parity_bits(own)
            for k, (band, apart, keys) in enumerate(sketches(own, similarity) if len(own) else [(-1, 0, own)]):
                at.append(i)
                for col, x in zip(out.values(), (*head, k == 0, band, apart, bits, keys.view(np.int64)), strict=True):
                    col.append(x)
        return out | {f.name: batch.column(f.name).take(pa.array(at, pa.int64())) for f in kept}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return map_arrow(docs, f"{schema}, {KEYED}", rows, STEP)


def _summed(key: np.ndarray, often: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each key once, in unsigned order: its count, and the least and greatest of its halves."""
    order = np.argsort(key.view(np.uint64))
    key = key[order]
    first = np.flatnonzero(np.concatenate((key[:1] == key[:1], key[1:] != key[:-1])))
    if not len(first):
        return key, often, a, b
    return key[first], np.add.reduceat(often[order], first), np.minimum.reduceat(a[order], first), np.maximum.reduceat(b[order], first)


def shared_keys(keyed: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(key, often) of the keys that different sets have, and how many rows of ``keyed`` have them.

    Nearly all keys occur once, so rows of them are never made: a task sums up about ``bucket`` keys
    at a time and packs them by ranges of keys, about ``bucket`` shingles a range, and ranges are summed
    up again. A key that many sets have is one entry of each pack, so ranges stay even.
    """
    total = keyed.where("band >= 0").agg(F.sum("n")).first()[0]
    ranges = max(1, math.ceil((total or 0) / bucket))

    def pack(keys: np.ndarray, halves: np.ndarray) -> pa.RecordBatch:
        key, often, a, b = _summed(keys, np.ones(len(keys), np.int64), halves, halves)
        place = ((key.view(np.uint64) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
        single = often == 1
        once, more = np.stack((key[single], a[single]), 1), np.stack([x[~single] for x in (key, often, a, b)], 1)
        of, found = np.unique(place), []
        for rows, at in ((once, place[single]), (more, place[~single])):
            found.append([rows[x:y].tobytes() for x, y in zip(np.searchsorted(at, of), np.searchsorted(at, of, "right"), strict=True)])
        return pa.RecordBatch.from_arrays([pa.array(of), *[pa.array(x, pa.binary()) for x in found]], ["range", "once", "more"])

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum([0, *batch.column("keys").value_lengths().to_pylist()])
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + bucket, "right")) - 1)
                part, at, lengths = batch.slice(at, to - at), to, np.diff(ends[at : to + 1])
                yield pack(np.asarray(part.column("keys").flatten(), np.int64), np.repeat(np.asarray(part.column("half"), np.int64), lengths))

    def merged(packed: pa.Table) -> pa.Table:
        once, more = (np.frombuffer(b"".join(packed.column(c).to_pylist()), np.int64).reshape(-1, n) for c, n in (("once", 2), ("more", 4)))
        of = lambda i, j: np.concatenate((once[:, i], more[:, j]))
        often = np.concatenate((np.ones(len(once), np.int64), more[:, 1]))
        key, often, a, b = _summed(of(0, 0), often, of(1, 2), of(1, 3))
        return pa.table({"key": key[a != b], "often": often[a != b]})

    half = F.xxhash64("name").alias("half")  # of two sets that share a key, the halves are the same once in 2**64
    packed = keyed.where("band >= 0").select("keys", half).mapInArrow(packs, "range int, once binary, more binary")
    return packed.groupBy("range").applyInArrow(merged, "key long, often long")


def meeting_keys(keyed: DataFrame) -> DataFrame:
    """(name, band, weight, key) of the keys by which a set can meet similar ones: the least frequent
    ``apart`` + 1 of its keys in a band, less those that no other set has. weight sums up how often
    the set's keys are met, so it is large for the original in the middle of a family of copies.

    Keys are counted once, in packed ranges; what is joined back has passed a bitmap
    of the keys that several sets have. A set with ``apart`` + 1 keys of its own drops out before.
    """
    spark = keyed.sparkSession
    shared = materialise(shared_keys(keyed), "shared-keys")
    bits = spark.sparkContext.broadcast(sieve(shared, shared.count()))

    def able(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, STEP) for whole in batches for at in range(0, whole.num_rows, STEP)):
            out: list[list] = [[], [], [], [], []]
            for name, band, apart, keys in zip(*(batch.column(c) for c in ("name", "band", "apart", "keys")), strict=True):
                own, apart = np.asarray(keys.values, np.int64), apart.as_py()
                hit = own[sifted(bits.value, own)] if len(own) else own
                if len(own) - len(hit) <= apart and len(hit):
                    for col, x in zip(out, (name.as_py(), band.as_py(), apart, len(own), hit), strict=True):
                        col.append(x)
            types = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["name", "band", "apart", "n_keys", "hit"])

    asked = keyed.where("band >= 0").select("name", "band", "apart", "keys")
    asked = asked.mapInArrow(able, "name binary, band int, apart int, n_keys int, hit array<long>").dropDuplicates(["name", "band"])
    asked = materialise(asked, "sets-that-may-meet")
    known = asked.select("name", "band", "apart", "n_keys", F.explode("hit").alias("key")).join(shared, "key")
    known = known.groupBy("name", "band", "apart", "n_keys").agg(
        F.sort_array(F.collect_list(F.struct("often", "key"))).alias("k"), F.sum("often").alias("weight")
    )
    known = materialise(known, "known-keys")  # sorted once, not for each use
    wanted = F.col("apart") + 1 - (F.col("n_keys") - F.size("k"))
    kept = known.where(wanted > 0).select("name", "band", "weight", F.explode(F.slice("k", F.lit(1), wanted)).alias("k"))
    return kept.select("name", "band", "weight", "k.key")


def close_pairs(n: np.ndarray, k: np.ndarray, bits: list[np.ndarray], second: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the sets that sizes, components ``k`` and parity bits leave as pairs: those of
    ``second`` with the others, or all with all where none or all are."""
    rows, cols = (np.flatnonzero(~second), np.flatnonzero(second)) if 0 < second.sum() < len(second) else (np.arange(len(n)),) * 2
    length = np.array([len(x) for x in bits])
    if len(bits) < 64:  # small ones are folded to one length
        length[:] = length.min()
    found = []
    for p in np.unique(length[rows]):
        for q in np.unique(length[cols]):
            i, j = rows[length[rows] == p], cols[length[cols] == q]
            least = min(p, q)
            x, y = (np.stack([np.bitwise_xor.reduce(bits[r].reshape(-1, least), axis=0) for r in side]).view(np.uint64) for side in (i, j))
            for at in range(0, len(i), 256):
                own = slice(at, at + 256)
                apart = np.zeros((len(i[own]), len(j)), np.int32)
                for w in range(least):
                    apart += np.bitwise_count(x[own, w, None] ^ y[None, :, w])
                both = n[i[own], None] + n[None, j]
                near = (apart <= both * ((1 - similarity) / (1 + similarity)) + _EPS) & (k[i[own], None] != k[None, j])
                near &= np.minimum(n[i[own], None], n[None, j]) >= np.maximum(n[i[own], None], n[None, j]) * similarity - _EPS
                if rows is cols:
                    near &= i[own, None] < j[None, :]
                a, b = np.nonzero(near)
                found.append((i[own][a], j[b]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def close_in_cells(met: DataFrame, sets: DataFrame, similarity: float, cell: int) -> DataFrame:
    """(src, dst) of the sets of one key in different components that bits do not rule out.

    A key's sets are cut into slices of about ``cell``, and each pair of slices is a cell. Cells are
    gathered by a shuffle and compared in numpy, a slice of the distances at a time; only close pairs
    come out, so neither rows nor memory follow the square of a group.
    """
    spread = F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")
    size = met.groupBy("band", "key").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("slices"))
    size = materialise(size.select(F.col("band").alias("b"), F.col("key").alias("h"), "slices"), "slices")
    own = met.join(size, (F.col("band") == F.col("b")) & (F.col("key") == F.col("h"))).withColumn("mine", spread)
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    own = own.join(sets.select("id", "bits"), "id").select(
        F.xxhash64("band", "key", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"),
        (F.col("mine") > F.col("other")).alias("second"), "id", "n", "k", "bits",
    )

    def pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells, ids, n, k, second = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("cell", "id", "n", "k", "second"))
        bits = [np.asarray(x.values, np.int64) for x in batch.column("bits")]
        src, dst = [ids[:0]], [ids[:0]]
        edges = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1], [True])))
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a > 1:
                i, j = close_pairs(n[a:b].astype(np.int64), k[a:b], bits[a:b], second[a:b].astype(bool), similarity)
                src.append(np.minimum(ids[a:b][i], ids[a:b][j]))
                dst.append(np.maximum(ids[a:b][i], ids[a:b][j]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (src, dst)], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last cell, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            cells = batch.column("cell").to_numpy()
            if cells[0] == cells[-1]:
                continue
            cut = int(np.searchsorted(cells, cells[-1]))
            whole = pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]).combine_chunks().to_batches()
            held = [batch.slice(cut)]
            yield from map(pairs, whole)
        if held:
            yield from map(pairs, pa.Table.from_batches(held).combine_chunks().to_batches())

    return own.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "src long, dst long")


def similar_sets(
    docs: DataFrame, keyed: DataFrame, words: int, similarity: float, likely: DataFrame | None = None, cell: int = 1024, rounds: int = 2
) -> DataFrame:
    """(name, root): a root for each set that links of at least ``similarity`` join to others.

    ``keyed`` is ``keyed_sets`` of ``docs`` with their content ``c``, written. Each key's sets, and the
    pairs ``likely`` (src, dst: names), are compared with one of them first, so that a family of copies
    gives one pair a set. Where that leaves a key's sets in several components, the next heaviest set
    is tried, as long as that joins any, ``rounds`` times at most. Of a key's sets that are still in
    different components, the parity bits of all pairs are compared, in cells of 2 * ``cell`` sets.
    """
    met = materialise(meeting_keys(keyed), "meeting-keys")
    several = met.groupBy("band", "key").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("band", "key")
    met = materialise(met.join(several, ["band", "key"]), "shared-meeting-keys")
    chosen = met.select("name").unionByName(likely.select(F.explode(F.array("src", "dst")).alias("name"))) if likely is not None else met.select("name")
    own = keyed.where("own").select("name", "c", "n", "bits").dropDuplicates(["name"]).join(chosen.distinct(), "name", "left_semi")
    # numbers for names, so that minima are of a fixed width; written, so that they stay
    sets = materialise(own.withColumn("id", F.monotonically_increasing_id()), "met-sets")
    met = materialise(met.join(sets.select("name", "id", "n"), "name").select("band", "key", "id", "n", "weight"), "met")

    def rows(batch: pa.RecordBatch) -> dict[str, list]:
        found = [shingle_set(t.as_py(), words) for t in batch.column("text")]
        return {"id": batch.column("id"), "shingles": [x.view(np.int64) for x in found]}

    texts = docs.select(content(F.col("text")).alias("c"), "text").join(sets.select("id", "c"), "c")
    whole = materialise(map_arrow(texts.select("id", "text"), "id long, shingles array<long>", rows, STEP).dropDuplicates(["id"]), "whole-sets")

    def linked(pairs: DataFrame, label: str) -> DataFrame:
        """The pairs (src, dst) of enough similarity. Sizes and parity bits rule most others out."""
        side = lambda df, name, a, x: df.select(F.col("id").alias(name), *[F.col(c).alias(d) for c, d in zip(a, x, strict=True)])
        both = pairs.join(side(sets, "src", ("n", "bits"), ("m", "x")), "src").join(side(sets, "dst", ("n", "bits"), ("n", "y")), "dst")
        both = both.where(F.least("m", "n") >= F.greatest("m", "n") * similarity - _EPS)
        both = both.where(bits_apart("x", "y") <= (F.col("m") + F.col("n")) * ((1 - similarity) / (1 + similarity)) + _EPS)
        both = materialise(both.select("src", "dst"), f"{label}-close")
        both = both.join(side(whole, "src", ("shingles",), ("x",)), "src").join(side(whole, "dst", ("shingles",), ("y",)), "dst")
        x, y, shared = F.size("x"), F.size("y"), F.size(F.array_intersect("x", "y"))
        return materialise(both.where(shared >= (x + y - shared) * similarity - _EPS).select("src", "dst"), f"{label}-linked")

    def in_components(links: DataFrame) -> DataFrame:
        """The rows of ``met`` whose key has sets of several components, with their component k."""
        label = connected_components(links)
        own = met.join(label, F.col("id") == F.col("node"), "left").withColumn("k", F.coalesce("component", "id")).drop("node", "component")
        apart = own.groupBy("band", "key").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a <> b").select("band", "key")
        return materialise(own.join(apart, ["band", "key"]), "met-by-component")

    links = None
    if likely is not None:
        number = lambda c: sets.select(F.col("name").alias(c), F.col("id").alias(f"{c}_id"))
        guessed = likely.join(number("src"), "src").join(number("dst"), "dst")
        links = linked(guessed.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")).distinct(), "likely")
    left = met.withColumn("k", F.col("id")) if links is None else in_components(links)
    tried = None
    for k in range(rounds):
        free = left if tried is None else left.join(tried, ["band", "key", "id"], "left_anti")
        best = F.max(F.struct("weight", "id", "k")).alias("best")
        pivots = materialise(free.groupBy("band", "key").agg(best).select("band", "key", "best.id", "best.k"), f"pivots-{k}")
        stars = left.join(pivots.select("band", "key", F.col("id").alias("pivot"), F.col("k").alias("of")), ["band", "key"]).where("k <> of")
        fresh = linked(stars.select(F.least("pivot", "id").alias("src"), F.greatest("pivot", "id").alias("dst")).distinct(), f"star-{k}")
        links = fresh if links is None else links.unionByName(fresh)
        left = in_components(links)
        if fresh.isEmpty():
            break
        tried = pivots.drop("k") if tried is None else tried.unionByName(pivots.drop("k"))

    pairs = materialise(close_in_cells(left, sets, similarity, cell).distinct(), "pairs")
    found = connected_components(links.unionByName(linked(pairs, "pair")))
    return sets.join(found, F.col("id") == F.col("node")).select("name", F.col("component").alias("root"))


def jaccard_components(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    component_id is the least doc_id reachable over links of at least ``similarity``, itself
    included. Copies are one set and meet in a ``min``. A text without words, or null, has no
    shingle and is linked with nothing, not even its like; one of fewer words than ``words`` is one
    shingle. A null doc_id keeps its row and names a component only where no other does. Repeated
    rows stay. A very long text is taken whole. Other columns play no part, whatever their names;
    an empty table gives no rows.
    """
    with scratch(docs.sparkSession):
        asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content(F.col("text")).alias("c"), "text")
        keyed = materialise(keyed_sets(asked, words, similarity), "keyed-sets")
        groups = similar_sets(docs, keyed, words, similarity)
        rows = materialise(keyed.where("own").select("doc_id", "name", F.col("n").cast("long").alias("n_shingles")), "rows-of-sets", keep=True)
        least = rows.where("n_shingles > 0").groupBy("name").agg(F.min("doc_id").alias("least_id"))
        least = materialise(least.join(groups, "name", "left"), "least-of-set")
        heads = least.where("root is not null").groupBy("root").agg(F.min("least_id").alias("head"))
        of_set = least.join(heads, "root", "left").select("name", F.coalesce("head", "least_id").alias("component_id"))
        of_set = materialise(of_set, "components-of-sets", keep=True)
    linked = rows.where("n_shingles > 0").join(of_set, "name").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op13_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document, at similarity 0.8 over five words."""
    return jaccard_components(table(spark, sf_dir, "documents"))
