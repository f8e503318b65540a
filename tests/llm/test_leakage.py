import random

import numpy as np
import pytest

from fareline.llm import leakage
from fareline.llm.canonical import canonical
from fareline.llm.leakage import leaked_passages, renamed_passages, template_classes, words_of

ITEM = "If 37 seats are free when the bus reaches Willet Terrace, how many remain once 133 people have boarded at Quarry Stadium?"
ITEMS = [(1, ITEM), (2, "The author doubts the peak load measured on Friday because the data clerk had moved the sensor beside Harrow Quay."), (3, "too short"), (4, None), (5, "")]


def passages(text):
    w = [x.casefold() for x in words_of(canonical(text or ""))]
    return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}


def brute(docs):
    return sorted({(d, i) for d, t in docs for i, x in ITEMS if passages(t) & passages(x)})


def frames(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as item_id"), spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "0 as doc_id")


DOCS = [
    (1, "Note: " + ITEM.upper()), (2, "seats are free when the bus reaches Willet Terrace how many remain and more"), (3, ITEM.replace("37", "38").replace("133", "99")), (4, ITEM.replace(" ", " \n").replace("e", "е")), (5, None), (6, ""),
    (7, "word " * 3000 + ITEM + " end" * 3000), (8, ITEMS[1][1].replace("Harrow Quay", "Mole Pier")), (9, " ".join(ITEM.split()[:11])), (10, " ".join(ITEM.split()[:12])), (1, "Note: " + ITEM.upper()), (11, "un​related " * 50),
]


@pytest.mark.parametrize("limit", [100_000, 0])
def test_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(leakage, "BROADCAST_WINDOWS", limit)
    d, i = frames(spark, DOCS)
    found = leaked_passages(d, i).select("doc_id", "item_id")
    assert sorted(tuple(r) for r in found.collect()) == brute(DOCS)
    assert leaked_passages(d.limit(0), i).count() == 0
    assert leaked_passages(d, i.limit(0)).count() == 0


def test_random_excerpts(spark):
    rng = random.Random(4)
    words = (ITEM + " " + ITEMS[1][1]).split()
    docs = []
    for n in range(120):
        parts = []
        for _ in range(3):
            a = rng.randrange(len(words))
            parts += words[a : a + rng.randint(8, 16)] + rng.choices(["bus", "late", "12", "Quay"], k=rng.randint(0, 2))
        docs.append((n, rng.choice([" ", ", ", "\n"]).join(parts)))
    d, i = frames(spark, docs)
    found = leaked_passages(d, i).select("doc_id", "item_id")
    assert sorted(tuple(r) for r in found.collect()) == brute(docs)


def test_renamed_passages(spark):
    docs = [(1, ITEM.replace("37", "41").replace("Willet", "Ostrow")), (2, ITEM), (3, ITEM.replace("seats are free", "benches stay empty").replace("how many remain", "which ones are left over")), (4, None), (1, "again")]
    d, i = frames(spark, docs)
    found = {(r.doc_id, r.class_id): (r.exact_windows > 0, r.renamed_windows > 0) for r in renamed_passages(d, i, least_literals=5).collect()}
    assert found == {(1, 1): (True, True)}  # the tail of the item is held word by word


def numbered(template, own):
    return leakage.numbered_hashes(np.array(template), np.array(own), np.array([0]))[0]


def test_slots_must_be_renamed_one_to_one():
    t = [leakage.NUMBER, 50, leakage.NUMBER, leakage.NAME] + list(range(60, 68))
    a = numbered(t, [5, 1, 5, 9] + [0] * 8)
    assert a == numbered(t, [7, 2, 7, 8] + [0] * 8)
    assert a != numbered(t, [5, 1, 6, 9] + [0] * 8)
    assert a != numbered(t, [7, 2, 8, 9] + [0] * 8)


# sentences of items, their slots to be filled, and sentences that only resemble them
FAMILIES = [
    "If {n} seats are free when the bus reaches {p}, how many of them remain once {m} people have boarded at {q}?",
    "The author doubts the peak load measured last spring because the clerk had moved the sensor beside {p} to {q}.",
    "Given that vehicle number {n} stood idle for {m} minutes, decide whether its next turn at {p} can be kept.",
    "A survey of {n} riders near {p} found {m} who would rather walk than change at {q} again.",
    "Suppose a planner moves {n} trips from {p} toward {q} and then asks which crew still returns before dark.",
]
OTHERS = [
    "If {n} seats stay empty after the bus has left {p}, the driver tells {m} people to wait for another at {q}.",
    "The author praises the peak load recorded last winter, and the clerk kept the sensor beside {p} near {q}.",
    "Vehicle number {n} was late for {m} minutes, which is why the turn at {p} had to be dropped again today.",
    "Of {n} riders near {p} we asked {m} about walking, and most of them like to change at {q} now.",
    "The planner cancelled {n} trips from {p} toward {q}, and no crew was told about it before the morning.",
]
PLACES = ["Willet Terrace", "Quarry Stadium", "Harrow Quay", "Mole Pier", "Sallow Gate", "Umber Mill", "Corvel Square", "Varley Bazaar"]


def filled(rng, text, places):
    p, q = rng.sample(places, 2)
    return text.format(n=rng.randint(2, 999), m=rng.randint(2, 999), p=p, q=q)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_planted_recall_and_precision(spark, monkeypatch, limit):
    monkeypatch.setattr(leakage, "BROADCAST_WINDOWS", limit)
    rng = random.Random(8)
    items = [(i, filled(rng, FAMILIES[i % 5], PLACES)) for i in range(40)]
    new = ["Ostrow Lane", "Pinder Hill", "Tarn Basin", "Lorrin Works"]
    docs, planted = [], set()
    for n in range(300):
        held = n % 3 == 0
        body = filled(rng, rng.choice(FAMILIES if held else OTHERS), new + PLACES[:3])
        docs.append((n, f"Morning note. {body} Nothing else was said."))
        planted |= {n} if held else set()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = renamed_passages(d, i).collect()
    found = {r.doc_id for r in rows}
    assert len(found & planted) >= 0.9 * len(planted) and len(found & planted) >= 0.9 * len(found)
    family = {}
    for r in template_classes(i).collect():
        family.setdefault(r.class_id, set()).add(r.item_id % 5)
    text = dict(docs)
    assert all(len(family[r.class_id]) == 1 for r in rows)
    right = [FAMILIES[min(family[r.class_id])].split("{")[0].split()[-1] in text[r.doc_id] for r in rows]
    assert sum(right) >= 0.9 * len(rows)
    assert len(rows) <= 3 * len(found)  # a row per class, not per item


def test_names_and_units_are_learned(spark):
    i = spark.createDataFrame([(1, "It took 12 Minuten from Alder Gate to the gate. Then 5 minutes, 7 minutes and the Alder Hill."), (2, "")], "item_id long, text string")
    lexicon = leakage.learn_lexicon(i, "text", 2**16)
    kinds = {w: lexicon.code(w)[0] for w in ("Alder", "alder", "gate", "minutes", "12", "V7", "Nowhere", "nowhere", "took")}
    assert kinds["Alder"] == kinds["alder"] == kinds["Nowhere"] == leakage.NAME and kinds["minutes"] == leakage.UNIT
    assert kinds["12"] == leakage.NUMBER and kinds["V7"] == leakage.CODE and kinds["nowhere"] == 0
    assert kinds["gate"] >= leakage.TYPES and kinds["took"] >= leakage.TYPES


def test_matches_come_through_the_templates_alone(spark, monkeypatch):
    d, i = frames(spark, DOCS)
    monkeypatch.setattr(leakage, "_bit_tables", lambda hashes, kinds, bits: [np.zeros(bits // 64, dtype=np.uint64)] * kinds)
    assert leaked_passages(d, i).count() == 0
