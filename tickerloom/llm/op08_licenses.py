"""License scans by template-markup matching.

A template is wording with markup: plain words must stand exactly, ``[[ ... ]]`` may be left
out, ``{{name:min-max}}`` stands for min to max words of any kind. Templates are compiled to
automata over tokens, and a text is accepted where an automaton reaches its end.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

#: Phrases and labels of the base.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Wording of public licenses and of their usual notices, whole.
_BSD_START = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "[[ {{mark:1-1}} ]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[[ {{mark:1-1}} ]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution "
)
_BSD_NAMES = (
    "[[ {{mark:1-1}} ]] neither the name of {{holder:1-12}} nor the names of [[ its ]] contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission "
)
_BSD_END = (
    "this software is provided by {{holders:1-12}} as is and any express or implied warranties including but not limited to the implied warranties "
    "of merchantability and fitness for a particular purpose are disclaimed in no event shall {{holders:1-12}} be liable for any direct indirect "
    "incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data "
    "or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including "
    "negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
TEMPLATES = {
    "apache-2.0-notice": (
        "licensed under the apache license version 2 0 [[ the license [[ you may not use this file except in compliance with the license "
        "[[ you may obtain a copy of the license at {{url:1-8}} unless required by applicable law or agreed to in writing software distributed under "
        "the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the "
        "specific language governing permissions and limitations under the license ]] ]] ]]"
    ),
    "bsd-2-clause": _BSD_START + _BSD_END,
    "bsd-3-clause": _BSD_START + _BSD_NAMES + _BSD_END,
    "cc-by-nc-4.0-notice": "licensed under [[ a ]] [[ the ]] [[ creative commons attribution noncommercial ]] [[ cc by nc ]] 4 0 [[ international ]] [[ license ]]",
    "gpl-notice": "[[ this {{what:1-3}} is ]] licensed under the gnu general public license [[ as published by the free software foundation ]] [[ either ]] version {{version:1-2}} [[ of the license or at your option any later version ]]",
    "gpl-terms": (
        "this {{what:1-3}} is free software you can redistribute it and or modify it under the terms of the gnu [[ lesser ]] [[ affero ]] general public "
        "license as published by the free software foundation [[ either ]] version {{version:1-2}} [[ of the license ]] [[ or at your option any later version ]] "
        "[[ this {{what:1-3}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose see the gnu [[ lesser ]] [[ affero ]] general public license for more details ]]"
    ),
    "isc-text": (
        "permission to use copy modify and [[ or ]] distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies the software is provided as is and {{author:1-8}} disclaims all warranties with "
        "regard to this software including all implied warranties of merchantability and fitness in no event shall {{author:1-8}} be liable for any special "
        "direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
        "negligence or other tortious action arising out of or in connection with the use or performance of this software"
    ),
    "mit-notice": "[[ released ]] [[ licensed ]] under [[ the terms of ]] the mit license",
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal "
        "in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies "
        "of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and "
        "this permission notice [[ including the next paragraph ]] shall be included in all copies or substantial portions of the software the software is "
        "provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular "
        "purpose and noninfringement in no event shall {{holders:1-8}} be liable for any claim damages or other liability whether in an action of contract tort "
        "or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ),
}

_WORD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and all that is not ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD).split()


@dataclass
class Automaton:
    """``step[s]`` maps a word to states, ``any[s]`` are states reached by any word, ``free[s]``
    without one. ``needs`` are words of the mandatory wording."""

    step: list[dict[bytes, list[int]]] = field(default_factory=list)
    any: list[list[int]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    needs: set[bytes] = field(default_factory=set)
    end: int = 0

    def new(self) -> int:
        self.step.append({})
        self.any.append([])
        self.free.append([])
        return len(self.step) - 1

    def closed(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def heads(self) -> set[bytes] | None:
        """Words a match can start with; None if any word will do."""
        start = self.closed({0})
        if any(self.any[s] for s in start):
            return None
        return {w for s in start for w in self.step[s]}

    def match(self, words: list[bytes], at: int) -> int:
        """End of the longest match that starts at ``at``, or -1."""
        states, best = self.closed({0}), -1
        for i in range(at, len(words) + 1):
            if self.end in states:
                best = i
            if i == len(words) or not states:
                break
            states = self.closed({t for s in states for t in (*self.step[s].get(words[i], ()), *self.any[s])})
        return best


_MARKUP = re.compile(r"(\[\[)|(\]\])|\{\{\w+:(\d+)-(\d+)\}\}|([^\s\[\]{}]+)")


def compile_template(source: str) -> Automaton:
    a = Automaton()
    here = a.new()
    opened: list[int] = []
    for m in _MARKUP.finditer(source):
        if m[1]:
            opened.append(here)
            here = a.new()
            a.free[opened[-1]].append(here)
        elif m[2]:
            after = a.new()
            a.free[here].append(after)
            a.free[opened.pop()].append(after)
            here = after
        elif m[3]:
            low, high = int(m[3]), int(m[4])
            after = a.new()
            for k in range(high + 1):
                if k >= low:
                    a.free[here].append(after)
                if k < high:
                    nxt = a.new()
                    a.any[here].append(nxt)
                    here = nxt
            here = after
        else:
            for word in words_of(m[5]):
                nxt = a.new()
                a.step[here].setdefault(word, []).append(nxt)
                if not opened:
                    a.needs.add(word)
                here = nxt
    if opened:
        raise ValueError("an optional region is not closed")
    a.end = here
    return a


@lru_cache(maxsize=4)
def compiled(templates: tuple[tuple[str, str], ...]) -> dict[str, tuple[Automaton, set[bytes] | None, bytes]]:
    built = {label: compile_template(source) for label, source in templates}
    if any(not a.needs for a in built.values()):
        raise ValueError("a template without mandatory words would match everywhere")
    return {k: (a, a.heads(), max(sorted(a.needs), key=len)) for k, a in built.items()}


def template_matches(words: list[bytes], raw: bytes, templates: tuple[tuple[str, str], ...]) -> list[tuple[str, int, int]]:
    """(label, first word, end) of every leftmost longest match, without overlaps by label.

    ``raw`` is the text's words, joined: it tells at once which templates cannot match.
    """
    found = []
    for label, (automaton, heads, rare) in compiled(templates).items():
        if rare not in raw or not all(n in raw for n in automaton.needs):
            continue
        i = 0
        while i < len(words):
            end = automaton.match(words, i) if heads is None or words[i] in heads else -1
            if end > i:
                found.append((label, i, end))
            i = max(i + 1, end)
    return found


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[str, int]]:
    """(label, first word) wherever a phrase's words stand one after another."""
    out = []
    for phrase, label in phrases.items():
        want = words_of(phrase)
        at = -1
        while True:
            try:
                at = words.index(want[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(want)] == want:
                out.append((label, at))
    return out


SCHEMA = (
    "doc_id long, n_words long, phrases array<struct<label:string,first:long>>, "
    "templates array<struct<label:string,first:long,end:long>>"
)


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Phrase places and accepted template spans of each row of ``docs`` (doc_id, text).

    Places are word numbers from 0. A null or empty text has no words and no finds; a very long
    text is scanned whole; of matches that start at one word the longest counts. Repeated rows are
    scanned one by one; an empty table gives no rows; other columns play no part. One pass without
    a shuffle.
    """
    frozen = tuple(sorted(templates.items()))

    def rows(batch: pa.RecordBatch) -> dict[str, list]:
        n, places, spans = [], [], []
        for value in batch.column("text"):
            words = words_of(value.as_py() or "")
            raw = b" ".join(words)
            n.append(len(words))
            hit = any(p.encode() in raw for p in phrases)
            places.append([{"label": a, "first": i} for a, i in phrase_places(words, phrases)] if hit else [])
            spans.append([{"label": a, "first": i, "end": e} for a, i, e in template_matches(words, raw, frozen)])
        return {"doc_id": batch.column("doc_id"), "n_words": n, "phrases": places, "templates": spans}

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), SCHEMA, rows)


def op8_template_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places and labels of every document; score 1 where a template is accepted, 0.5 where
    only a phrase stands, else 0."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    names = lambda *cols: F.array_join(F.array_sort(F.array_distinct(F.concat(*cols))), ",")
    return found.select(
        "doc_id", "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.first").alias("first_word"),
        F.array_max("phrases.first").alias("last_word"),
        names(F.col("phrases.label")).alias("base_labels"),
        names(F.col("phrases.label"), F.col("templates.label")).alias("labels"),
        F.when(F.size("templates") > 0, 1.0).when(F.size("phrases") > 0, 0.5).otherwise(0.0).alias("score"),
    )


def _regex(source: str) -> str:
    """A template as a regular expression over words that a blank follows each."""
    part = lambda m: "(?:" if m[1] else ")?" if m[2] else f"(?:[^ ]+ ){{{m[3]},{m[4]}}}" if m[3] else "".join(w.decode() + " " for w in words_of(m[5]))
    return "".join(part(m) for m in _MARKUP.finditer(source))


def _places_sql(phrase: str, label: str) -> str:
    want = phrase.split()
    stands = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(want))
    return f"list_transform(list_filter(range(len(w) - {len(want) - 1}), lambda i: {stands}), lambda i: struct_pack(label := '{label}', first := i))"


#: A template is accepted somewhere if its regular expression is found between words.
ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS line FROM documents
), words AS (
  SELECT doc_id, ' ' || line || ' ' AS line, CASE WHEN line = '' THEN [] ELSE string_split(line, ' ') END AS w FROM d
), found AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, {' || '.join(_places_sql(p, x) for p, x in PHRASES.items())} AS p,
         list_filter([{', '.join(f"CASE WHEN regexp_matches(line, ' {_regex(t)}') THEN '{n}' END" for n, t in TEMPLATES.items())}], lambda x: x IS NOT NULL) AS accepted
  FROM words
), named AS (
  SELECT *, list_transform(p, lambda x: x.first) AS firsts, list_distinct(list_transform(p, lambda x: x.label)) AS base FROM found
)
SELECT doc_id, n_words, CAST(len(p) AS BIGINT) AS n_base, list_min(firsts) AS first_word, list_max(firsts) AS last_word,
       coalesce(array_to_string(list_sort(base), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(base || accepted)), ','), '') AS labels,
       CAST(CASE WHEN len(accepted) > 0 THEN 1 WHEN len(p) > 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS score
FROM named
"""
