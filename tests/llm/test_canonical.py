import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fareline.llm.canonical import canonical, canonical_texts, look_alike_classes, look_alike_pairs

SAME = [
    ("Café à 10:15", "Café à 10:15"), ("Halt 12", "Ｈａｌｔ　１２"), ("no stop", "no s​t­op"), ("office", "oﬃce"), ("depot A", "dеpоt А"), ("A-1", "Α‑1"), ("résidence", "rе́sidеncе"), ("ëx", "ёx"), ("a b", "a b"),
]
DIFFERENT = [("Cafe", "Café"), ("stop", "Stop"), ("a b", "a  b"), ("10", "11"), ("x2", "x²"), ("a-b", "a—b"), ("a b", "ab"), ("рейс", "рейд")]


def test_pairs_of_texts():
    assert [a for a, b in SAME if canonical(a) != canonical(b)] == []
    assert [a for a, b in DIFFERENT if canonical(a) == canonical(b)] == []


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_form_is_stable_and_composed(text):
    once = canonical(text)
    assert canonical(once) == once and unicodedata.is_normalized("NFC", once)


def test_duckdb_gives_the_same_form(spark):
    texts = [a for pair in SAME + DIFFERENT for a in pair] + ["", None, "x" * 100_000 + "е", "it's ' \\ [a-z] ]^ ’", "ﬁﬂ"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as key", "1 as form")
    assert {r.doc_id: r.text for r in canonical_texts(df).collect()} == {i: t if t is None else canonical(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("max_rows", [250_000, 1])
def test_found_pairs(spark, max_rows):
    texts = ["stop A", "stop А", "stop A", "st​op A", "other", "other", None, "", ""]
    df = spark.createDataFrame([(i * 10, t) for i, t in enumerate(texts)] + [(0, "stop A")], "doc_id long, text string")
    assert sorted(tuple(r) for r in look_alike_pairs(look_alike_classes(df), max_rows=max_rows).collect()) == [(0, 10), (0, 30), (10, 20), (10, 30), (20, 30)]
    assert look_alike_pairs(look_alike_classes(df.limit(0))).count() == 0
