import datetime as dt

import pytest

from fareline.operators import orphans

T = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


@pytest.mark.parametrize("broadcast", [50_000, 0])
@pytest.mark.parametrize("max_rows", [250_000, 5])
def test_reasons(spark, monkeypatch, broadcast, max_rows):
    monkeypatch.setattr(orphans, "BROADCAST_KEYS", broadcast)
    refs = [("known", T, 1, "x"), ("gone", T, 2, "x"), ("gone", T - 2 * HOUR, 3, "x"), ("nowhere", T, 4, "x"), ("later", T, 5, "x"), ("later", T + 2 * HOUR, 6, "x"), (None, T, 7, "x"), ("", T, 8, "x"), ("gone_unlisted", T, 9, "x"), ("later", None, 10, "x"), ("gone", None, 11, "x")]
    refs += [("known", T, 100 + i, None) for i in range(40)] + [("Known", T, 12, "x")]
    parents = spark.createDataFrame([("known", T), ("known", T), ("gone", T - 9 * HOUR), ("later", T + HOUR), ("later", T + 3 * HOUR), (None, T), ("", T)], "k string, seen timestamp_ntz")
    deleted = spark.createDataFrame([("gone", T - HOUR), ("gone", T + HOUR), ("gone_unlisted", T), (None, T)], "key string, deleted_at timestamp_ntz")
    found = orphans.orphan_references(spark.createDataFrame(refs, "key string, at timestamp_ntz, id int, note string"), orphans.parents_of(parents, "k", "seen", deleted), max_rows)
    assert sorted((r.id, r.reason) for r in found.collect()) == [(2, "deleted"), (4, "missing"), (5, "late"), (9, "deleted"), (11, "deleted"), (12, "missing")]


def test_empty_tables(spark):
    refs = spark.createDataFrame([("a", T, 1)], "key string, at timestamp_ntz, id int")
    none = spark.createDataFrame([], "k string, seen timestamp_ntz")
    deleted = spark.createDataFrame([], "key string, deleted_at timestamp_ntz")
    assert [r.reason for r in orphans.orphan_references(refs, orphans.parents_of(none, "k", "seen", deleted)).collect()] == ["missing"]
    assert orphans.orphan_references(refs.limit(0), orphans.parents_of(none, "k", None, deleted)).count() == 0
    with pytest.raises(ValueError):
        orphans.orphan_references(refs.withColumn("reason", refs.key), orphans.parents_of(none, "k", None, deleted))


def test_several_parents_in_one_pass(spark, monkeypatch):
    none = spark.createDataFrame([], "key string, deleted_at timestamp_ntz")
    one = orphans.parents_of(spark.createDataFrame([("a", T)], "k string, seen timestamp_ntz"), "k", "seen", none)
    two = orphans.parents_of(spark.createDataFrame([("b", T)] * 3, "k string, seen timestamp_ntz"), "k", None, none)
    refs = spark.createDataFrame([("a", T, "one", 1), ("a", T, "two", 2), ("b", T, "one", 3), ("b", T - HOUR, "two", 4), ("a", T - HOUR, "one", 5), ("a", T, "none", 6), ("a", T, None, 7)] + [("b", T, "two", 100 + i) for i in range(30)], "key string, at timestamp_ntz, parent string, id int")
    for keys in (10, 2, 0):
        monkeypatch.setattr(orphans, "BROADCAST_KEYS", keys)
        found = orphans.orphan_references(refs, {"one": one, "two": two}, 5)
        assert sorted((r.id, r.reason) for r in found.collect()) == [(2, "missing"), (3, "missing"), (5, "late")]


def test_filter_has_no_false_negatives(spark):
    from pyspark.sql import functions as F

    keys = spark.range(5000).selectExpr("cast(id as string) key")
    few = spark.range(50_000, 50_010).selectExpr("cast(id as string) key")
    probe = orphans.might_contain(spark, orphans.build_filters([(keys, 5000), (few, 10)]))
    assert keys.where(~probe(keys.key, F.lit(0))).count() == 0
    assert few.where(~probe(few.key, F.lit(1))).count() == 0
    others = spark.range(10_000, 30_000).selectExpr("cast(id as string) key")
    assert others.where(probe(others.key, F.lit(0))).count() < 600
    assert keys.where(probe(keys.key, F.lit(1))).count() < 200
