"""Benchmark decontamination by template canonicalisation. DataFrame functions only.

Words are lower-cased and stripped of punctuation; numbers, units after them and names become
typed placeholders, so a question with other numbers or names has the same template. Documents
meet benchmark items in a hash join of template windows of five words. What the placeholders of a
match stand for is then compared: one filler in the question must be one filler in the document.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch, table

WINDOW, SIMILARITY = 5, 0.8
#: Windows that may be broadcast: at 16 bytes each, 32 MB. More are joined by shuffling.
BROADCAST_WINDOWS = 2_000_000

#: Marks put before what a placeholder stands for; no text is split at them.
NUMBER, UNIT, NAME = "\ue000", "\ue001", "\ue002"
KINDS = {NUMBER: "number", UNIT: "unit", NAME: "name"}

#: Units of measure and money, lower-cased.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz pound pounds gram grams "
    "kilogram kilograms ton tons ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes "
    "h hr hour hours day days week weeks month months year years mph hz khz mhz ghz w kw v a j kj cal kcal pa "
    "usd eur gbp dollar dollars euro euros cent cents percent degrees degree celsius fahrenheit"
).split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    A column that a lambda looks into is inlined by the optimizer, and would then be computed
    anew for every element; a lambda's own variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: A capital that opens a word, does not open a sentence, and has small letters after it.
_NAME = (
    r"\p{Lu}(?<=[^\p{L}\p{N}]\p{Lu})(?<![.!?][\"')\]]{0,2}[ \t\n\r]{1,3}\p{Lu})\p{Ll}+(?![\p{L}\p{N}])"
)
_NUMBER = r"(?<![\p{L}\p{N}])[0-9]+"
_UNIT = rf"(?i)({NUMBER}[0-9]+[ -]{{1,3}})({'|'.join(sorted(map(re.escape, UNITS), key=len, reverse=True))})(?![\p{{L}}\p{{N}}])"
#: What parts words: anything but letters, the marks on them, digits and our own marks.
_BLANK = rf"[^\p{{L}}\p{{M}}\p{{N}}{NUMBER}-{NAME}]+"


def template_words(text: Column, fillers: bool) -> Column:
    """The words of a text in order, in small letters, with placeholders for numbers, units
    that follow a number, and names.

    A placeholder is its mark; with ``fillers`` what it stands for comes after it. Anything but
    letters and digits parts words. A capitalised word is a name unless it opens a sentence;
    text in capitals has no names. A null text has no words.
    """
    kept = "$0" if fillers else ""
    text = F.coalesce(text, F.lit(""))
    marked = text.contains(NUMBER) | text.contains(UNIT) | text.contains(NAME)  # a byte search, and seldom true
    clean = F.when(marked, F.regexp_replace(text, f"[{NUMBER}-{NAME}]", " ")).otherwise(text)
    named = F.regexp_replace(clean, _NAME, f"{NAME}{kept}")
    joined = F.regexp_replace(named, "(?<=[0-9])[.,:/](?=[0-9])", "")
    numbered = F.regexp_replace(joined, _NUMBER, f"{NUMBER}$0 ")
    measured = F.regexp_replace(numbered, _UNIT, f"$1 {UNIT}" + ("$2" if fillers else ""))
    if not fillers:
        measured = F.regexp_replace(measured, f"{NUMBER}[0-9]+", NUMBER)
    whole = F.when(named.rlike("[0-9]"), measured).otherwise(named)
    return F.array_remove(F.split(F.lower(whole), _BLANK), "")


def window_hashes(words: Column, n: int = WINDOW) -> Column:
    """Hash of every run of ``n`` words; of the whole, if it is shorter; none of no words."""

    def windows(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))))
        return F.transform(
            F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])
        )

    return let(words, windows)


def kinds(words: Column) -> Column:
    """Template words without their fillers."""
    return F.transform(words, lambda w: F.when(F.substring(w, 1, 1).isin(*KINDS), F.substring(w, 1, 1)).otherwise(w))


def literals(words: Column) -> Column:
    """Template words without their marks."""
    return F.transform(words, lambda w: F.ltrim(w, F.lit("".join(KINDS))))


def full_template(text: Column) -> Column:
    """A struct of words (with fillers), wins (the template's windows) and raw_wins (literal)."""
    return let(
        template_words(text, True),
        lambda w: F.struct(
            w.alias("words"), window_hashes(kinds(w)).alias("wins"), window_hashes(literals(w)).alias("raw_wins")
        ),
    )


def both_windows(words: Column) -> Column:
    """Hashes of a text's template windows, and of its literal ones where they differ."""
    return let(
        words,
        lambda w: F.concat(
            window_hashes(kinds(w)), F.when(F.exists(w, lambda x: F.substring(x, 1, 1).isin(*KINDS)), window_hashes(literals(w))).otherwise(F.array().cast("array<bigint>"))
        ),
    )


def anchors(items: DataFrame, similarity: float) -> DataFrame:
    """(h, item): enough windows of each item (item, wins, raw_wins) that no match can miss them all.

    A match holds at least ``similarity`` of an item's n distinct template windows, so it holds one
    of any n - ceil(similarity * n) + 1; those shared by fewest items are taken. It may hold one as
    a template or by its very words, so each brings its literal windows along.
    """
    each = items.select("item", F.explode(F.arrays_zip("wins", "raw_wins")).alias("w")).select("item", F.col("w.wins").alias("h"), F.col("w.raw_wins").alias("raw"))
    each = each.groupBy("item", "h").agg(F.collect_set("raw").alias("raws"))
    spread = each.groupBy("h").agg(F.count(F.lit(1)).alias("in_items"))
    ranked = each.join(spread, "h").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("in_items", "h", "raws"))).alias("r"))
    need = F.size("r") - F.ceil(F.lit(similarity) * F.size("r") - F.lit(1e-9)) + 1
    taken = ranked.select("item", F.explode(F.slice("r", F.lit(1), need.cast("int"))).alias("a"))
    return taken.select("item", F.explode(F.array_union(F.array("a.h"), "a.raws")).alias("h")).distinct()


def places() -> Column:
    """(q, p, literal): each window of an item and where it first stands in a document, both from 1.

    Over one row with both templates, so neither is exploded."""
    literal = lambda k: F.array_position("d.raw_wins", F.get("i.raw_wins", k - 1))
    template = lambda k: F.array_position("d.wins", F.get("i.wins", k - 1))
    at = F.transform(
        F.sequence(F.lit(1), F.size("i.wins")),
        lambda k: F.struct(
            k.alias("q"), F.when(literal(k) > 0, literal(k)).otherwise(template(k)).cast("int").alias("p"), (literal(k) > 0).alias("literal")
        ),
    )
    return F.filter(at, lambda x: x["p"] > 0)


def slots(item: Column, doc: Column) -> Column:
    """(item, doc) for each placeholder in a run of an item's words: its filler in both texts."""
    both = F.zip_with(item, doc, lambda a, b: F.struct(a.alias("item"), F.ltrim(b, F.lit("".join(KINDS))).alias("doc")))
    return F.filter(both, lambda s: F.substring(s["item"], 1, 1).isin(*KINDS))


def consistent(fillers: str) -> Column:
    """Whether each of the item's fillers, in a list of different pairs, stands for one of the document's."""
    return F.size(fillers) == F.size(F.array_distinct(F.transform(fillers, lambda s: s["item"])))


def aligned(pairs: DataFrame, similarity: float) -> DataFrame:
    """The matches among ``pairs`` (doc_id, item_id, i, d, n_windows) that hold in regions of the document.

    A region is what lies near one offset p - q of places, up to 2 words, a quarter or a half of
    the item away; each of the item's windows is placed in it as near to the offset as it occurs. What
    was put into the middle of a copy moves the rest of it to another region, so regions are chained:
    from each consistent one on, the others are taken in by size, if all fillers stay consistent.
    """
    key = ["doc_id", "item_id", "text_key"]
    pairs = pairs.select("doc_id", "item_id", F.xxhash64("d.words").alias("text_key"), "i", "d", "n_windows").dropDuplicates(key)

    def windows(side: str) -> Column:
        own = lambda x, k: F.struct(
            (k + 1).alias("at"), x["wins"].alias("win"), x["raw_wins"].alias("raw"), F.slice(f"{side}.words", k + 1, WINDOW).alias("words")
        )
        return F.explode(F.transform(F.arrays_zip(f"{side}.wins", f"{side}.raw_wins"), own))

    asked = pairs.select(*key, "n_windows", F.size("i.words").alias("reach"), windows("i").alias("w"))
    asked = asked.select(*key, "n_windows", "reach", "w.*", F.explode(F.array_distinct(F.array("w.win", "w.raw"))).alias("h"))
    there = pairs.select(*key, windows("d").alias("v")).select(*key, "v.*")
    there = there.select(*key, F.col("at").alias("p"), F.col("words").alias("found"), F.explode(F.array_distinct(F.array("win", "raw"))).alias("h"))
    hits = asked.join(there, [*key, "h"]).select(
        *key, "n_windows", "reach", "win", F.col("at").alias("q"), "p", (F.col("p") - F.col("at")).alias("offset"), slots(F.col("words"), F.col("found")).alias("own")
    )
    hits = materialise(hits.distinct(), "places")
    cell = lambda c: F.floor(F.col(c) / F.col("reach"))
    regions = hits.select(*key, "reach", F.col("offset").alias("centre")).distinct()
    regions = regions.select(*key, "centre", F.explode(F.array(cell("centre") - 1, cell("centre"), cell("centre") + 1)).alias("cell"))
    away = F.abs(F.col("offset") - F.col("centre"))
    widths = F.array_distinct(F.array(F.lit(2), F.floor(F.col("reach") / 4).cast("int"), F.floor(F.col("reach") / 2).cast("int")))
    near = hits.withColumn("cell", cell("offset")).join(regions, [*key, "cell"]).withColumn("away", away).withColumn("width", F.explode(widths)).where("away <= width")
    one = near.groupBy(*key, "n_windows", "centre", "width", "q").agg(F.min(F.struct("away", "p", "win", "own")).alias("best"))
    fillers = F.array_sort(F.array_distinct(F.flatten(F.collect_list("best.own")))).alias("fillers")
    regions = one.groupBy(*key, "n_windows", "centre", "width").agg(F.array_sort(F.collect_set("best.win")).alias("wins"), fillers).where(consistent("fillers"))
    regions = materialise(regions.select(*key, "n_windows", "wins", "fillers").distinct(), "regions")
    share = F.col("matched") / F.col("n_windows")
    single = regions.withColumn("matched", F.size("wins")).withColumn("similarity", share).where(F.col("similarity") >= similarity)
    # those that no region holds alone
    left = regions.join(single.select(*key).distinct(), key, "left_anti")
    left = left.groupBy(*key, "n_windows").agg(F.sort_array(F.collect_list(F.struct(F.size("wins").alias("n"), "wins", "fillers")), asc=False).alias("chain"))
    chained = left.withColumn("first", F.explode("chain")).select(*key, "n_windows", chain_from("first", "chain").alias("c"))
    chained = chained.select(*key, "n_windows", F.size("c.wins").alias("matched"), "c.fillers").withColumn("similarity", share)
    return single.drop("wins").unionByName(chained.where(F.col("similarity") >= similarity), allowMissingColumns=True)


def chain_from(first: str, chain: str) -> Column:
    """(wins, fillers) of a region and all that can be chained to it, the largest first."""

    def add(held: Column, more: Column) -> Column:
        return let(
            F.array_union(held["fillers"], more["fillers"]),
            lambda both: F.when(
                F.size(both) == F.size(F.array_distinct(F.transform(both, lambda s: s["item"]))),
                F.struct(F.array_union(held["wins"], more["wins"]).alias("wins"), both.alias("fillers")),
            ).otherwise(held),
        )

    return F.aggregate(chain, F.struct(F.col(f"{first}.wins").alias("wins"), F.col(f"{first}.fillers").alias("fillers")), add)


def short_matches(docs: DataFrame, known: DataFrame) -> DataFrame | None:
    """None if there are no such items, or the matches (doc_id, item_id, ...) of items of fewer than ``WINDOW`` words inside longer texts.

    Such an item has one window, of all its words; a text holds it by its very words, or by its
    template with consistent fillers. Texts are cut into windows of just the lengths that occur.
    """
    held = known.where(F.size("i.words") < WINDOW).select("item_id", F.size("i.words").alias("n"), F.col("i.words").alias("asked"), F.get("i.wins", F.lit(0)).alias("win"), F.get("i.raw_wins", F.lit(0)).alias("raw"))
    held = held.withColumn("h", F.explode(F.array_distinct(F.array("win", "raw"))))
    sizes = sorted(r["n"] for r in held.select("n").distinct().collect())  # at most WINDOW - 1 of them
    if not sizes:
        return None
    words = docs.select("doc_id", template_words(F.col("text"), True).alias("w")).where(F.size("w") >= WINDOW)
    found = None
    for n in sizes:
        own = held.where(F.col("n") == n).select("item_id", "asked", "h")
        runs = words.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))).alias("found"))  # noqa: B023
        runs = runs.select("doc_id", "found", F.explode(both_windows(F.col("found"))).alias("h"))
        met = runs.join(own, "h").withColumn("fillers", F.array_distinct(slots(F.col("asked"), F.col("found"))))
        met = met.where((literals(F.col("asked")) == literals(F.col("found"))) | consistent("fillers"))
        found = met if found is None else found.unionByName(met)
    one = found.groupBy("doc_id", "item_id").agg(F.min(F.size("fillers")).alias("slots"))
    return one.select("doc_id", "item_id", F.lit(1).alias("n_windows"), F.lit(1).alias("matched"), F.lit(1.0).alias("similarity"), "slots")


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, n_windows, matched, similarity, slots): matches of ``docs`` (doc_id, text)
    with ``items`` (item_id, text).

    ``matched`` counts the item's distinct windows whose template, or whose very words, stand in
    the document; a match has at least ``similarity`` of them. Either that many stand there
    literally, or its fillers are consistent: a number, unit or name of the item stands for one
    and the same filler wherever it is matched. ``slots`` is how many different fillers were
    compared. Literal places of a window are preferred to template ones, and of several the first
    counts; where these are not consistent, regions are tried, and chains of them (``aligned``).

    Null and empty texts have no windows and never match; an item shorter than a window has one window,
    of all its words. Repeated rows give repeated matches of a document only once. A row without
    doc_id or item_id cannot be named and is left out. A very long text is taken whole, its template
    made once for all its items. An empty table gives no matches. Other columns play no part.
    """
    with scratch(docs.sparkSession):
        docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
        asked = items.select("item_id", "text").where("item_id is not null").distinct()
        known = materialise(
            asked.select("item_id", full_template(F.col("text")).alias("i")).select(F.xxhash64("item_id", "i.words").alias("item"), "item_id", "i"),
            "benchmark",
        ).where("size(i.wins) > 0")
        marks = materialise(anchors(known.select("item", "i.wins", "i.raw_wins"), similarity), "anchors")
        windows = docs.select("doc_id", F.explode(both_windows(template_words(F.col("text"), True))).alias("h"))
        small = marks.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
        near = windows.join(F.broadcast(marks) if small else marks, "h").select("doc_id", "item").distinct()
        pairs = materialise(near, "candidates")
        # texts are read again for candidates only, once however many items they may hold
        wanted = materialise(pairs.groupBy("doc_id").agg(F.collect_set("item").alias("own_items")), "suspects")
        close = docs.join(wanted, "doc_id").select("doc_id", "own_items", full_template(F.col("text")).alias("d"))
        close = materialise(close, "suspect-templates").withColumn("item", F.explode("own_items")).drop("own_items")
        both = materialise(close.join(known, "item").withColumn("at", places()), "alignments")
        slot = F.flatten(F.transform("at", lambda x: slots(F.slice("i.words", x["q"], WINDOW), F.slice("d.words", x["p"], WINDOW))))
        share = lambda at: F.size(F.array_distinct(F.transform(at, lambda x: F.get("i.wins", x["q"] - 1))))
        judged = both.select(
            "doc_id", "item_id", "i", "d",
            F.size(F.array_distinct("i.wins")).alias("n_windows"),
            share(F.col("at")).alias("matched"),
            share(F.filter("at", lambda x: x["literal"])).alias("verbatim"),
            F.array_distinct(slot).alias("fillers"),
        )
        judged = judged.withColumn("similarity", F.col("matched") / F.col("n_windows")).where(F.col("similarity") >= similarity)
        proved = (F.col("verbatim") / F.col("n_windows") >= similarity) | consistent("fillers")
        judged = materialise(judged.withColumn("proved", proved), "judged")
        shown = ["doc_id", "item_id", "similarity", "matched", "n_windows", F.size("fillers").alias("slots")]
        matches = judged.where("proved").select(*shown).unionByName(aligned(judged.where("not proved"), similarity).select(*shown))
        best = matches.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", "matched", "n_windows", "slots")).alias("m"))
        best = best.select("doc_id", "item_id", "m.n_windows", "m.matched", "m.similarity", "m.slots")
        short = short_matches(docs, known)
        if short is not None:
            best = best.unionByName(short.select(*best.columns)).dropDuplicates(["doc_id", "item_id"])
        return materialise(best, "matches", keep=True)


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with that item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
