import random
import re

import pandas as pd
from helpers import LONG, documents, frame
from pyspark.sql import functions as F

from tickerloom.llm import op02_decontamination as d

ITEM = "If Anna buys 12 apples for 3 euros each and Bob eats 5 kg of them how much does Anna have left over at noon"


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def found(spark, texts, bench=((1, ITEM),), **kw):
    docs = frame(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    return {(r.doc_id, r.item_id): r for r in d.contaminated(docs, items(spark, list(bench)), **kw).collect()}


def test_parameters_change_but_the_template_stays(spark):
    got = found(spark, [
        "intro words here. " + ITEM + " and so on",
        ITEM.replace("12", "1,700").replace("Anna", "Zoe").replace("3 euros", "4 dollars").replace("5 kg", "6 lb"),
        ITEM.upper(),
        "| " + ITEM.replace(" ", " | ") + " |",
        # one filler of the question becomes two: Anna is Zoe, then Mia
        ITEM.replace("Anna", "Zoe", 1).replace("Anna", "Mia"),
        " ".join(ITEM.split()[:12]),
        "something else entirely without any of it",
    ])
    assert set(got) == {(0, 1), (1, 1), (2, 1), (3, 1)}
    assert got[0, 1].similarity == 1 and got[1, 1].slots >= 5


def test_similarity_is_a_share_of_windows(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(50)]
    bench = [(7, " ".join(words))]  # 46 windows; cutting k words at the end loses k of them
    texts = [" ".join(words[: 50 - k]) for k in (0, 9, 10)]
    assert set(found(spark, texts, bench)) == {(0, 7), (1, 7)}


def plain(docs, bench):
    tok = lambda x: re.findall(r"[^\W_]+", x.lower())
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    asked = {i: grams(tok(t)) for i, t in zip(bench.item_id, bench.text, strict=True)}
    out = set()
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        own = grams(tok(text))
        out |= {(doc, i) for i, g in asked.items() if g and len(g & own) >= 0.8 * len(g)}
    return out


def test_matches_brute_force_on_literal_passages(spark):
    sf = "/root/testdata/sf0.01"
    want = plain(documents(sf), pd.read_parquet(f"{sf}/benchmark.parquet"))
    got = {(r.doc_id, r.item_id) for r in d.op2_template_decontamination(spark, sf).collect()}
    assert want and got == want


def test_words_and_placeholders(spark):
    text = "Ann paid 5 km and 1,200.50 USD to Bob. He ran 12kg in B2B"
    row = spark.createDataFrame([(text,)], "t string").select(d.template_words(F.col("t"), True).alias("a"), d.template_words(F.col("t"), False).alias("b")).first()
    strip = [w[0] if w[0] in d.KINDS else w for w in row.a]
    assert strip == row.b
    assert [w[1:] for w in row.a if w[0] in d.KINDS] == ["5", "km", "120050", "usd", "bob", "12", "kg"]


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    texts = [ITEM, "x", ITEM + " tail"]
    want = set(found(spark, texts))
    monkeypatch.setattr(d, "BROADCAST_WINDOWS", 0)
    assert set(found(spark, texts)) == want == {(0, 1), (2, 1)}


def test_awkward_rows(spark):
    bench = items(spark, [(1, None), (2, ""), (3, "same text of a few words here"), (3, "same text of a few words here"), (None, "no id at all in this row"), (4, "two words")])
    got = {(r.doc_id, r.item_id) for r in d.contaminated(frame(spark), bench).collect()}
    assert got == {(4, 3), (5, 3)}
    assert d.contaminated(frame(spark).limit(0), bench).count() == 0
    assert d.contaminated(frame(spark), bench.limit(0)).count() == 0
    assert found(spark, [LONG + ITEM])[0, 1].similarity == 1


def test_other_case_and_layout_is_found(spark):
    item = "Tell Anna that every Friday Bob and Carla meet near Oslo. Then Dora asks Emil whether Fred and Greta left Hamburg before Ida came"
    texts = [item.title(), item.lower(), item.replace(".", ""), item.replace(" ", "\n"), "• " + item.replace(" ", " • "), item.replace(" ", ". "), item.replace(" ", " “", 3)]
    assert {d for d, _ in found(spark, texts, [(1, item)])} == set(range(len(texts)))


def test_anchors_cover_a_match_by_words_alone(spark):
    item = " ".join(f"Name{chr(97 + i)} w{chr(97 + i)}" for i in range(20))
    got = found(spark, [item.title(), " ".join(item.lower().split()[4:]), " ".join(item.title().split()[:-7])], [(1, item)])
    assert set(got) == {(0, 1), (1, 1), (2, 1)}


def test_words_alone_prove_a_match(spark):
    item = "we count 12 " + " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(53)) + " and 12 more of these"
    got = found(spark, [item.replace(" and 12 more", " and 13 more")], [(1, item)])
    assert set(got) == {(0, 1)} and got[0, 1].similarity == 1


def test_a_later_variant_is_looked_at(spark):
    zoe = ITEM.replace("Anna", "Zoe").replace("12", "40").replace("Bob", "Tim")
    mia = ITEM.replace("Anna", "Mia").replace("12", "50").replace("Bob", "Kim")
    partial = " ".join(zoe.split()[:14])  # its other windows are placed in the later variant
    mixed = " ".join(zoe.split()[:14] + ["with", "nothing"] + mia.split()[14:])
    got = found(spark, [partial + " and so forth. " + mia + " at last", partial + " and so forth", mixed, LONG + partial + ". " + mia])
    assert set(got) == {(0, 1), (3, 1)}


def test_items_under_five_words_are_found_inside_texts(spark):
    bench = [(1, "what year"), (2, "Ask Bob 12 times"), (3, "one two three four five six")]
    texts = [
        "some words before then what year? more words", "What year", "what about the year then and so", "so ask Kim 7 times, they said then",
        "we ask nobody at all times of day", "zero one two three four five six seven", "",
    ]
    assert set(found(spark, texts, bench)) == {(0, 1), (1, 1), (3, 2), (5, 3)}


def test_copies_with_insertions_beside_partial_variants(spark):
    rng = random.Random(5)
    texts, want, bench = [], set(), []
    for k in range(8):
        t = template(rng)
        while len(t) < 34:
            t = template(rng)
        bench.append((k, fill(t, fillers(rng))))
        own, other = next((a, b) for a, b in iter(lambda: (fillers(rng), fillers(rng)), None) if not set(a.values()) & set(b.values()))
        noise = lambda n: " ".join(f"z{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(n))
        half, decoy = len(t) // 2, fill(t[:23], other)
        copy = f"{fill(t[:half], own)} {noise(24)} {fill(t[half:], own)}"
        for text in (copy, f"{decoy} {noise(9)} {copy}", f"{copy} {noise(9)} {decoy}", f"{decoy}. {copy}. {decoy}"):
            want.add((len(texts), k))
            texts.append(text)
    assert set(found(spark, texts, bench)) == want


NAMES = "Anna Bob Carla Dora Emil Fred Greta Hugo Ida Jonas Karl Lena Mona Nils Olga Paul Rita Sven Tina Udo".split()


def template(rng):
    """Words with slots: a filler's place is a number of a name (negative) or a number (positive)."""
    words = [f"q{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(rng.randrange(22, 45))]
    for slot in (-1, -2, 1, 2):
        for at in rng.sample(range(1, len(words)), 3):
            words[at] = slot
    return words


def fill(words, values):
    return " ".join(values[w] if isinstance(w, int) else w for w in words)


def fillers(rng):
    names, numbers = rng.sample(NAMES, 2), rng.sample(range(10, 99), 2)
    return {-1: names[0], -2: names[1], 1: str(numbers[0]), 2: str(numbers[1])}


def test_complete_variants_are_found_whatever_partial_ones_stand_by(spark):
    rng = random.Random(11)
    templates = {i: template(rng) for i in range(1, 13)}
    bench = [(i, fill(t, fillers(rng))) for i, t in templates.items()]
    texts, want = [], set()

    def add(text, *found_items):
        want.update((len(texts), i) for i in found_items)
        texts.append(text)

    for i, t in templates.items():
        part = lambda share: fill(t[: int(len(t) * share)], fillers(rng))
        rest = lambda share: fill(t[int(len(t) * share) :], fillers(rng))
        whole = fill(t, fillers(rng))
        noise = " ".join(f"z{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(rng.randrange(3, 80)))
        add(whole, i)
        add(f"{part(0.6)}. {noise}. {whole}", i)
        add(f"{whole}. {noise}. {part(0.7)}", i)
        add(f"{part(0.7)}. {rest(0.4)}. {noise} {whole}. {part(0.5)} {rest(0.5)}", i)
        one, two = next((a, b) for a, b in iter(lambda: (fillers(rng), fillers(rng)), None) if not set(a.values()) & set(b.values()))
        half = len(t) // 2
        if {w for w in t[:half] if isinstance(w, int)} & {w for w in t[half:] if isinstance(w, int)}:
            add(f"{noise} {fill(t[:half], one)} {noise} {fill(t[half:], two)}")  # the halves have other fillers
        add(f"{part(0.7)} and nothing more {noise}")
        other = next(j for j in templates if j != i)
        add(f"{part(0.6)} {noise} {whole} {fill(templates[other], fillers(rng))}", i, other)
    assert set(found(spark, texts, bench)) == want
