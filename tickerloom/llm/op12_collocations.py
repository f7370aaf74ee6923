"""Phrase collocations by dynamic itemset counting over cyclic shard scans.

The corpus is cut into blocks, and these into shards that are scanned in turn, again and again. Words
are counted from the start; a longer phrase begins to be counted at the first scan after both its
subphrases (all but the last word, all but the first) have reached the threshold, in whichever shard
that is, and goes on until it has met every shard once. So lengths are counted side by side, and what
is frequent is known long before a pass for each length would have ended. Counts are exact: each
phrase's cycle is the whole corpus, and what never becomes active contains something rarer than the
threshold.

A block knows its words by numbers of its own. At a scan it asks for the numbers of those of its
distinct words that are active: a join of distinct words, not of tokens. Then it counts its pairs of
neighbouring active words, and of the longer windows those whose two subphrases may be active: a bitmap
of bounded size tells, and a join of the sums with the active phrases drops what it let through by
mistake. Only what can begin or go on is counted, so a late scan counts little. Most pairs are rare, so
rows of them are never made: blocks pack them by ranges of a hash, ranges are summed up in numpy, and
only frequent pairs come out as rows. A block is bounded by
``block_bytes`` or one text; nothing else is held whole.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, fresh_path, map_arrow, materialise, remove, scratch, table, tidy_shuffles
from .sieve import mixed, sieve, sifted

#: What ends a piece.
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
_BYTES = bytes.maketrans((ASCII_UPPER + PIECE_ENDS + "\t").encode(), (ASCII_LOWER + "\n" * len(PIECE_ENDS) + " ").encode())


@dataclass(frozen=True)
class Settings:
    """``threshold``: the least count of a phrase, of up to ``longest`` words. A candidate is dropped
    where a longer one has ``covered`` percent of its count or more. ``first``: rows a group."""

    longest: int = 3
    threshold: int = 10
    covered: int = 50
    first: int = 2000
    shards: int = 2
    block_bytes: int = 4 << 20
    range_words: int = 1 << 20  # words of the corpus for each range of pairs


SCANS = 63  # the low bits of a word's number are the scan after which it was active
BLOCKS = "shard int, block long, lang string, ids binary, words array<binary>, n array<long>"


def tokens(text: bytes) -> list[bytes]:
    """Lower-case words; a newline by itself ends a piece."""
    return [w for w in text.translate(_BYTES).replace(b"\n", b" \n ").split(b" ") if w]


def blocks_of(docs: DataFrame, settings: Settings) -> DataFrame:
    """The texts of ``docs`` (lang, text) in blocks of one language: the words in order as the block's
    own numbers (-1 ends a piece), the distinct words, and how often each occurs."""

    def pack(lang: str, held: list[bytes], number: int) -> pa.RecordBatch:
        of: defaultdict[bytes, int] = defaultdict()
        of.default_factory = of.__len__
        of[b"\n"]
        found = tokens(b"\n".join(held))
        ids = np.fromiter(map(of.__getitem__, found), np.int32, len(found)) - 1
        n = np.bincount(ids[ids >= 0], minlength=len(of) - 1)
        row = ([number % settings.shards], [number], [lang], [ids.tobytes()], [list(of)[1:]], [n])
        types = (pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], [x.split()[0] for x in BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        part = TaskContext.get().partitionId()
        number = (part << 24) + part  # blocks of small partitions go to different shards
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_buffer().to_pybytes()
                held.setdefault(lang, []).append(raw)
                size[lang] = size.get(lang, 0) + len(raw)
                if size[lang] >= settings.block_bytes:
                    yield pack(lang, held.pop(lang), number)
                    number, size[lang] = number + 1, 0
        for lang, own in held.items():
            yield pack(lang, own, number)
            number += 1

    asked = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return asked.mapInArrow(run, BLOCKS)


def _key(words: list[np.ndarray]) -> np.ndarray:
    """A hash of each window, given its words by place."""
    h = np.zeros(len(words[0]), np.uint64)
    for w in words:
        h = mixed(h ^ w.view(np.uint64))
    return h.view(np.int64)


def columns(k: int) -> list[str]:
    return [f"w{i}" for i in range(1, k + 1)]


def pack_pairs(words: list[np.ndarray], n: np.ndarray, ranges: int) -> tuple[np.ndarray, list[bytes]]:
    """Ranges of the hash of the pairs that have any, and the pairs and counts of each."""
    place = ((_key(words).view(np.uint64) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.uint16 if ranges < 1 << 16 else np.uint32)
    order = np.argsort(place, kind="stable")
    place, rows = place[order], np.stack([x[order] for x in (*words, n)])
    of = np.unique(place)
    ends = zip(np.searchsorted(place, of), np.searchsorted(place, of, "right"), strict=True)
    return of.astype(np.int32), [rows[:, x:y].tobytes() for x, y in ends]


def sum_pairs(packs: list[bytes]) -> np.ndarray:
    """Words and total counts of the pairs of ``packs``, each once."""
    rows = np.concatenate([np.frombuffer(x, np.int64).reshape(3, -1) for x in packs], axis=1)
    h = _key([rows[0], rows[1]])
    order = np.argsort(h)
    h, rows = h[order], rows[:, order]
    other = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
    if (other & (h[1:] == h[:-1])).any():  # two pairs with one hash may lie mixed
        rows = rows[:, np.lexsort(rows[:2])]
        other = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
    first = np.flatnonzero(np.concatenate(([True], other)))
    return np.stack((rows[0, first], rows[1, first], np.add.reduceat(rows[2], first)))


def count_windows(held: DataFrame, answers: DataFrame, longest: int, unfinished: int, sieves, ranges: int) -> DataFrame:
    """(k, w1, ..., n, range, pack): how often each window of k active words that is still to be counted occurs
    in each of the blocks ``held``, by ``answers`` (block, at, id, since) on which of their words are active.

    A pair is to be counted if it began after scan ``unfinished``; pairs are packed by ``ranges``. A longer
    window must have both subphrases in the bitmap of the active ones of that length and one of them in
    that of those that became active after ``unfinished``; when it began, the bitmaps do not know.
    """
    names = ["k", *columns(longest), "n", "range", "pack"]
    types = [pa.int32(), *[pa.int64()] * longest, pa.int64(), pa.int32(), pa.binary()]

    def table_of(k: int, words: list[np.ndarray], n: np.ndarray) -> pa.Table:
        nulls = lambda size: [pa.nulls(size)] * longest
        if k == 2:
            place, packs = pack_pairs(words, n, ranges)
            cols = [np.full(len(place), k, np.int32), *nulls(len(place)), pa.nulls(len(place)), place, packs]
        else:
            cols = [np.full(len(n), k, np.int32), *words, *nulls(len(n))[k:], n, pa.nulls(len(n)), pa.nulls(len(n))]
        return pa.table([c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    def run(tokens: pa.Table, found: pa.Table) -> pa.Table:
        out = [table_of(2, [np.zeros(0, np.int64)] * 2, np.zeros(0, np.int64))]
        if tokens.num_rows and found.num_rows:
            at, ids, since = (np.asarray(found.column(c).combine_chunks()) for c in ("at", "id", "since"))
            own = np.frombuffer(tokens.column("ids")[0].as_py(), np.int32)
            place = np.full(max(int(own.max(initial=-1)), int(at.max())) + 2, -1, np.int64)  # -1 stays -1
            place[at] = np.arange(len(at))
            own = place[own]
            # at each place the number of the window that begins there, -1 where it is of no use
            number, size, words, late = own, max(1, len(at)), [ids], since > unfinished
            for k in range(2, longest + 1):
                code = np.where((number[:-1] >= 0) & (number[1:] >= 0), number[:-1] * size + number[1:], -1)
                seen, where, n = np.unique(code, return_inverse=True, return_counts=True)
                none = int(len(seen) > 0 and seen[0] < 0)
                seen, n, where = seen[none:], n[none:], where - none  # -1 is no window
                head, tail = seen // size, seen % size
                words = [*[w[head] for w in words], words[-1][tail]]
                counted = late[head] | late[tail]
                out.append(table_of(k, [w[counted] for w in words], n[counted]))
                if k == longest or sieves.value.get(k) is None:
                    break
                active, fresh = sieves.value[k]
                live = sifted(active, _key(words))
                number = np.concatenate((np.where(live, np.cumsum(live) - 1, -1), [-1]))[where]
                size = max(1, int(live.sum()))
                words = [w[live] for w in words]
                late = sifted(fresh, _key(words))
                if not late.any() and sieves.value.get(k + 1) is None:
                    break
        return pa.concat_tables(out)

    schema = ", ".join(["k int", *[f"{c} long" for c in columns(longest)], "n long, range int, pack binary"])
    return held.select("block", "ids").groupBy("block").cogroup(answers.withColumnRenamed("block", "of").groupBy("of")).applyInArrow(run, schema)


class Length:
    """What is known of the phrases of one length: those still being counted, and the active ones."""

    def __init__(self, k: int, settings: Settings):
        self.k, self.settings = k, settings
        self.keys = columns(k) if k > 1 else ["lang", "word"]
        self.sums: list[tuple[str, DataFrame]] = []  # (folder, sums) of each scan, apart by whether the cycle has ended
        self.active: DataFrame | None = None  # (keys, since), and the id of a word
        self.n_active, self.last_start = 0, 0

    def add(self, counts: DataFrame, scan: int) -> None:
        """Take in the counts (keys, start, n) of a scan; phrases that reach the threshold are
        active from the next scan on. Phrases whose cycle ends below it are forgotten."""
        s, spark, label = self.settings, counts.sparkSession, f"length-{self.k}"
        if self.sums:
            counts = counts.unionByName(self.sums[-1][1].where("not ended").drop("ended"))
        total = counts.groupBy(*self.keys, "start").agg(F.sum("n").alias("n")).withColumn("ended", F.col("start") + s.shards - 1 <= scan)
        path = fresh_path(spark, label)
        with tidy_shuffles(spark):
            total.where(~F.col("ended") | (F.col("n") >= s.threshold)).write.partitionBy("ended").parquet(path)
        if self.sums:
            remove(spark, f"{self.sums[-1][0]}/ended=false")
        total = spark.read.schema(total.schema).parquet(path)
        self.sums.append((path, total))
        self._activate(total.where(F.col("n") >= s.threshold).select(*self.keys), scan)

    def add_packs(self, packs: DataFrame, scan: int) -> None:
        """The same for pairs (range, pack). Those whose cycle goes on stay packed, and the
        rows are the frequent ones. A pair began when the later of its words was active, which the
        words' numbers tell."""
        threshold, lag, spark = self.settings.threshold, self.settings.shards - 1, packs.sparkSession
        if self.sums:
            packs = packs.unionByName(self.sums[-1][1].where("packed").select("range", "pack"))

        def summed(held: pa.Table) -> pa.Table:
            rows = sum_pairs(held.column("pack").to_pylist())
            ended = np.maximum(rows[0] & SCANS, rows[1] & SCANS) + 1 + lag <= scan
            often = rows[2] >= threshold
            size, on = int(often.sum()), int(not ended.all())
            pad = lambda x, t: pa.concat_arrays([pa.array(x, t), pa.nulls(on, t)])
            cols = [pad(x[often], pa.int64()) for x in rows]
            ended_of = pad(ended[often], pa.bool_())
            place = pa.concat_arrays([pa.nulls(size, pa.int32()), held.column("range").combine_chunks().slice(0, on)])
            pack = pa.concat_arrays([pa.nulls(size, pa.binary()), pa.array([rows[:, ~ended].tobytes()] * on, pa.binary())])
            packed = pa.array(np.arange(size + on) >= size)
            return pa.table([*cols, ended_of, place, pack, packed], ["w1", "w2", "n", "ended", "range", "pack", "packed"])

        schema = "w1 long, w2 long, n long, ended boolean, range int, pack binary, packed boolean"
        total, path = packs.groupBy("range").applyInArrow(summed, schema), fresh_path(spark, f"length-{self.k}")
        with tidy_shuffles(spark):
            total.write.partitionBy("packed").parquet(path)
        if self.sums:
            remove(spark, f"{self.sums[-1][0]}/packed=true")
        total = spark.read.schema(total.schema).parquet(path)
        self.sums.append((path, total))
        self._activate(total.where("not packed").select(*self.keys), scan)

    def _activate(self, fresh: DataFrame, scan: int) -> None:
        label = f"length-{self.k}"
        if self.active is not None:
            fresh = fresh.join(self.active, self.keys, "left_anti")
        if self.k == 1:
            fresh = fresh.withColumn("id", F.shiftleft(F.monotonically_increasing_id(), SCANS.bit_length()) + scan)
        fresh = materialise(fresh.withColumn("since", F.lit(scan + 1)), f"{label}-active", keep=True)
        n = fresh.count()
        if n:
            self.active = fresh if self.active is None else self.active.unionByName(fresh)
            self.n_active, self.last_start = self.n_active + n, scan + 1

    def bitmaps(self, unfinished: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the active phrases, and of those that became active after scan ``unfinished``."""
        keys = self.keys  # tasks take these along, and not what else is known here
        key = lambda b: {"key": _key([np.array(b.column(c), np.int64) for c in keys])}
        bits = lambda df: sieve(map_arrow(df.select(*keys), "key long", key), self.n_active)
        return bits(self.active), bits(self.active.where(F.col("since") > unfinished))

    def frequent(self) -> DataFrame:
        """(keys, n), and the id of a word, when all cycles have ended."""
        rows = "ended and not packed" if self.k == 2 else "ended"  # packs of earlier scans are gone
        ended = [df.where(rows).select(*self.keys, "n") for _, df in self.sums]
        total = ended[0]
        for more in ended[1:]:
            total = total.unionByName(more)
        return total.join(self.active.select("lang", "word", "id"), self.keys) if self.k == 1 else total

    def forget(self, spark: SparkSession) -> None:
        for path, _ in self.sums:
            remove(spark, path)


def frequent_phrases(docs: DataFrame, settings: Settings) -> tuple[DataFrame, list[Length]]:
    """(lang, total) of all words, and the frequent phrases of each length."""
    s, spark = settings, docs.sparkSession
    if s.shards * s.longest > 63:
        raise ValueError("shards times words must be under 64")
    blocks = materialise(blocks_of(docs, s), "blocks")
    totals = materialise(blocks.groupBy("lang").agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total")), "words-of-languages")
    ranges = max(1, math.ceil((totals.agg(F.sum("total")).first()[0] or 0) / s.range_words))
    lengths = [Length(k, s) for k in range(1, s.longest + 1)]
    answered: dict[int, DataFrame] = {}  # by shard, once all words are known
    scan = 0
    while scan < s.shards or any(scan < x.last_start + s.shards for x in lengths[:-1]):
        at, unfinished = scan % s.shards, scan - s.shards
        shard = blocks.where(F.col("shard") == at)
        words = lengths[0].active
        with scratch(spark):
            counts: list[tuple[Length, DataFrame]] = []
            pairs = None
            if words is not None:
                if at in answered:
                    answers = answered[at]
                else:
                    asked = shard.select("block", "lang", F.posexplode("words").alias("at", "word"))
                    answers = materialise(asked.join(words, ["lang", "word"]).select("block", "at", "id", "since"), "answers", keep=scan >= s.shards)
                    if scan >= s.shards:
                        answered[at] = answers
                # a length is looked at as long as it, or a longer one, makes windows that are to be counted
                going = [scan < x.last_start + s.shards for x in lengths[:-1]]
                sieves = {x.k: x.bitmaps(unfinished) for x in lengths[1:-1] if x.n_active and any(going[x.k - 1 :])}
                found = materialise(count_windows(shard, answers, s.longest, unfinished, spark.sparkContext.broadcast(sieves), ranges), "windows")
                for x in lengths[1:]:
                    own = found.where(F.col("k") == x.k)
                    if x.k == 2 and scan < lengths[0].last_start + s.shards:
                        pairs = own.select("range", "pack")
                    elif x.k - 1 in sieves:  # which of them are made of active phrases, and since when
                        sums = own.groupBy(*x.keys).agg(F.sum("n").alias("n"))
                        for side, keys in (("p", x.keys[:-1]), ("q", x.keys[1:])):
                            below = lengths[x.k - 2]
                            part = below.active.select(*[F.col(c).alias(d) for c, d in zip(below.keys, keys, strict=True)], F.col("since").alias(side))
                            sums = sums.join(part, keys)
                        sums = sums.withColumn("start", F.greatest("p", "q")).where(F.col("start") > unfinished)
                        counts.append((x, sums.select(*x.keys, "start", "n")))
            if scan < s.shards:
                counted = shard.select("lang", F.inline(F.arrays_zip("words", "n")))
                counts.append((lengths[0], counted.select("lang", F.col("words").alias("word"), F.lit(0).alias("start"), "n")))
            if pairs is not None:
                lengths[1].add_packs(pairs, scan)
            for x, counted in counts:
                x.add(counted, scan)
        scan += 1
    return totals, [x for x in lengths if x.n_active]


def collocations(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of each language that hold together best.

    Of a phrase of count a, cut after any of its words into parts of counts l and r, the lowest
    floor(1000000 * a * a / (l * r)) is its score, at the earliest such cut. Phrases most of whose
    occurrences lie in a longer candidate are left out. Arithmetic is in decimals of 38 digits. A null
    text is empty, a null language ``und``; repeated rows count each; a very long text is one block;
    an empty table gives no rows; other columns play no part.
    """
    s = settings
    with scratch(docs.sparkSession):
        totals, lengths = frequent_phrases(docs, s)
        found = [materialise(x.frequent(), f"frequent-{x.k}") for x in lengths]
        for x in lengths:
            x.forget(docs.sparkSession)
        if not found:
            found = [docs.sparkSession.createDataFrame([], "lang string, word binary, n long, id long")]
        # heads and tails: the counts of a phrase's first and last 1, 2, ... words, all of it included
        one = F.array("n")
        phrases = [found[0].select(F.col("id").alias("w1"), "lang", F.array(F.col("word").cast("string")).alias("words"), "n", one.alias("heads"), one.alias("tails"))]
        for k, longer in enumerate(found[1:], 2):
            below = materialise(phrases[-1], "phrases")
            phrases[-1] = below
            left = below.select(*columns(k - 1), "lang", F.col("words").alias("w"), "heads")
            right = below.select(*[F.col(c).alias(d) for c, d in zip(columns(k - 1), columns(k)[1:], strict=True)], F.element_at("words", -1).alias("last"), "tails")
            own = longer.join(left, columns(k - 1)).join(right, columns(k)[1:])
            add = lambda c: F.concat(c, F.array("n"))
            phrases.append(own.select(*columns(k), "lang", F.concat("w", F.array("last")).alias("words"), "n", add("heads").alias("heads"), add("tails").alias("tails")))
        kept = []
        for k, own in enumerate(phrases):
            if not k:
                continue
            if k + 1 < len(found):
                keys, more = columns(k + 1), columns(k + 2)
                inside = None
                for part in (more[:-1], more[1:]):
                    side = found[k + 1].select(*[F.col(c).alias(d) for c, d in zip(part, keys, strict=True)], F.col("n").alias("longer"))
                    inside = side if inside is None else inside.unionByName(side)
                own = own.join(inside.groupBy(*keys).agg(F.max("longer").alias("longer")), keys, "left").where(f"longer IS NULL OR 100 * longer < {s.covered} * n")
            big = lambda c: c.cast("decimal(19,0)")
            cuts = [(F.col("heads")[j - 1], F.col("tails")[k - j]) for j in range(1, k + 1)]
            own = own.select("lang", F.array_join("words", " ").alias("phrase"), F.col("n").alias("a"), F.array(*[F.struct(a.alias("l"), b.alias("r")) for a, b in cuts]).alias("cuts"), big(F.col("n")).alias("d"))
            own = own.withColumn("best", F.array_min(F.expr(
                "transform(cuts, (x, i) -> struct((1000000BD * d * d) div (cast(x.l as decimal(19,0)) * cast(x.r as decimal(19,0))) AS score, i, x.l, x.r))"
            )))
            kept.append(own.select("lang", "phrase", "a", "best.l", "best.r", "best.score"))
        if not kept:
            kept = [found[0].select("lang", F.col("word").cast("string").alias("phrase"), *[F.col("n").alias(c) for c in ("a", "l", "r", "score")]).where("false")]
        every = kept[0]
        for more in kept[1:]:
            every = every.unionByName(more)
        order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        top = every.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= s.first)
        top = top.join(totals.withColumnRenamed("total", "n"), "lang")
        return materialise(top.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations", keep=True)


def op12_dynamic_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two or three words of each language of the documents."""
    return collocations(table(spark, sf_dir, "documents"))


#: Every window counted at once.
ORACLE_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces
), n1 AS (SELECT lang, x AS w1, count(*) AS f FROM (SELECT lang, unnest(ws) AS x FROM w) GROUP BY ALL
), n2 AS (
  SELECT lang, x[1] AS w1, x[2] AS w2, count(*) AS f
  FROM (SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: [ws[i], ws[i + 1]])) AS x FROM w WHERE len(ws) > 1) GROUP BY ALL
), n3 AS (
  SELECT lang, x[1] AS w1, x[2] AS w2, x[3] AS w3, count(*) AS f
  FROM (SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: [ws[i], ws[i + 1], ws[i + 2]])) AS x FROM w WHERE len(ws) > 2) GROUP BY ALL
  HAVING count(*) >= 10
), inside AS (
  SELECT lang, w1, w2, max(f) AS longer FROM (SELECT lang, w1, w2, f FROM n3 UNION ALL SELECT lang, w2, w3, f FROM n3) GROUP BY ALL
), cuts AS (
  SELECT n2.lang, n2.w1 || ' ' || n2.w2 AS phrase, n2.f AS a, x.f AS l, y.f AS r, 1 AS k
  FROM n2 JOIN n1 x ON x.lang = n2.lang AND x.w1 = n2.w1 JOIN n1 y ON y.lang = n2.lang AND y.w1 = n2.w2
  LEFT JOIN inside i ON i.lang = n2.lang AND i.w1 = n2.w1 AND i.w2 = n2.w2
  WHERE n2.f >= 10 AND (longer IS NULL OR 100 * longer < 50 * n2.f)
  UNION ALL
  SELECT n3.lang, n3.w1 || ' ' || n3.w2 || ' ' || n3.w3, n3.f, x.f, y.f, 1
  FROM n3 JOIN n1 x ON x.lang = n3.lang AND x.w1 = n3.w1 JOIN n2 y ON y.lang = n3.lang AND y.w1 = n3.w2 AND y.w2 = n3.w3
  UNION ALL
  SELECT n3.lang, n3.w1 || ' ' || n3.w2 || ' ' || n3.w3, n3.f, x.f, y.f, 2
  FROM n3 JOIN n2 x ON x.lang = n3.lang AND x.w1 = n3.w1 AND x.w2 = n3.w2 JOIN n1 y ON y.lang = n3.lang AND y.w1 = n3.w3
), scored AS (
  SELECT *, CAST((1000000 :: HUGEINT * a * a) // (l :: HUGEINT * r) AS BIGINT) AS score FROM cuts
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM n1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN totals USING (lang) QUALIFY rank <= 2000
"""
