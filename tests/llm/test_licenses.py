import random
import re

import pytest
from compare import differences
from helpers import documents, frame

from tickerloom.llm import op08_licenses as lic


def plain(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    at = sorted((i, label) for p, label in lic.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    return len(w), at


def test_whole_table(spark, sf):
    docs = documents("/root/testdata/sf0.01")
    text = dict(zip(docs.doc_id, docs.text, strict=True))
    rows = lic.op8_template_automata(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs) and sum(r.n_base for r in rows) > 0
    for r in rows:
        n, at = plain(text[r.doc_id])
        assert (r.n_words, r.n_base) == (n, len(at))
        assert (r.first_word, r.last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    with_line = [r for r in rows if "Released under the MIT License" in text[r.doc_id]]
    assert with_line and all("mit-notice" in r.labels and r.score == 1.0 for r in with_line)


@pytest.mark.parametrize("text, ok", [
    ("a b", True), ("a x b", True), ("a x y b", False), ("a b c", True), ("a c b", False), ("b", False), ("A, (opt)? b!", False),
])
def test_automaton(text, ok):
    a = lic.compile_template("a [[ x ]] b")
    w = lic.words_of(text)
    assert any(a.match(w, i) > 0 for i in range(len(w))) == (ok if text != "a c b" else False)


def test_replaceable_and_nested_regions():
    a = lic.compile_template("copyright {{year:1-2}} [[ by [[ the ]] {{who:1-3}} ]] end")
    full = lambda t: a.match(lic.words_of(t), 0) == len(lic.words_of(t))
    assert full("copyright 2020 end") and full("copyright 2020 2021 by the free software foundation end")
    assert full("copyright 2020 by me end")
    assert not full("copyright end") and not full("copyright 1 2 3 end") and not full("copyright 2020 by a b c d e end")


def test_markup_errors():
    with pytest.raises(ValueError):
        lic.compile_template("a [[ b")
    with pytest.raises(ValueError):
        lic.compiled((("x", "[[ only ]] {{any:1-2}}"),))


def test_mandatory_wording_is_exact(spark):
    apache = "Licensed under the Apache License, Version 2.0"
    rows = [(1, apache, None, None), (2, apache.replace("Version", "Release"), None, None), (3, apache.replace(",", " --"), None, None)]
    got = {r.doc_id: [t.label for t in r.templates] for r in lic.scan_licenses(frame(spark, rows)).collect()}
    assert got == {1: ["apache-2.0-notice"], 2: [], 3: ["apache-2.0-notice"]}


def test_awkward_rows(spark):
    rows = lic.scan_licenses(frame(spark)).collect()
    assert len(rows) == 10 and {r.doc_id: r.n_words for r in rows}[6] == 60_000
    assert {r.doc_id: r.n_words for r in rows}[1] == 0
    assert lic.scan_licenses(frame(spark).limit(0)).count() == 0


def filled(label, drop=None, holder="the example project and its friends"):
    """A text that a template describes: optional parts out, places filled, a comma here and there."""
    source = lic.TEMPLATES[label]
    while "[[" in source:
        source = re.sub(r"\[\[[^\[\]]*\]\]", " ", source)
    words = re.sub(r"\{\{\w+:(\d+)-(\d+)\}\}", lambda m: " ".join(holder.split()[: int(m[2])]), source).split()
    return ", ".join(" ".join(w) for w in (words[:7], [w for i, w in enumerate(words[7:]) if i != drop])).capitalize()


@pytest.mark.parametrize("label", [n for n in lic.TEMPLATES if n.endswith(("-text", "-clause", "-terms"))])
def test_whole_licenses_match_exactly(spark, label):
    whole = "Copyright 2020 A. " + filled(label) + ". More text"
    n = len(lic.words_of(filled(label)))
    cut = filled(label).rsplit(" ", 1)[0] if not label.startswith("gpl") else filled(label).split("version")[0]
    rows = [(1, whole, None, None), (2, filled(label, drop=5), None, None), (3, cut, None, None)]
    got = {r.doc_id: [(t.label, t.first, t.end) for t in r.templates] for r in lic.scan_licenses(frame(spark, rows)).collect()}
    assert got == {1: [(label, 3, 3 + n)], 2: [], 3: []}


def test_spans_match_regular_expressions():
    """Leftmost longest spans over random words, by trying every end with a regular expression."""
    rnd = random.Random(3)
    templates = {"x": "a [[ b ]] {{n:0-2}} c", "y": "b [[ a [[ c ]] ]] b", "z": "c {{n:1-3}} a [[ a ]]"}
    frozen = tuple(sorted(templates.items()))

    def regex(source):
        out = re.sub(r"\{\{\w+:(\d+)-(\d+)\}\}", r"(?:\\w+ ){\1,\2}", source.replace("[[ ", "(?:").replace(" ]]", ")?"))
        return re.compile(re.sub(r"\b([abc])\b ?(?![,}])", r"\1 ", out).replace("}) ", "})").replace("} ", "}").replace(")? ", ")?").replace(")(", ")("))

    for _ in range(300):
        words = [rnd.choice(["a", "b", "c", "d"]) for _ in range(rnd.randrange(14))]
        want = []
        for label, source in frozen:
            i, r = 0, regex(source)
            while i < len(words):
                ends = [e for e in range(i + 1, len(words) + 1) if r.fullmatch(" ".join(words[i:e]) + " ")]
                if ends:
                    want.append((label, i, max(ends)))
                i = max([i + 1, *ends])
        raw = [w.encode() for w in words]
        assert lic.template_matches(raw, b" ".join(raw), frozen) == want


def test_matches_sql(spark, sf, con):
    assert differences(lic.op8_template_automata(spark, sf).toPandas(), lic.ORACLE_SQL, con) == ""
