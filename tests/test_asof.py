import random

import pytest

from fareline.operators.asof import current_states, state_asof_join

EVENTS = "k string, at bigint, id int"
VERSIONS = "k string, start bigint, end bigint, p int, v string"


def brute(events, versions):
    out = []
    for k, at, i in events:
        fit = [x for x in versions if k is not None and at is not None and x[0] == k and x[1] is not None and x[1] <= at and (x[2] is None or at < x[2])]
        best = max(fit, key=lambda x: (x[3], x[1], x[4]), default=None)
        out.append((i, best and best[4], any(x[0] == k and x[1] is not None and (x[2] is None or x[2] > x[1]) for x in versions)))
    return sorted(out, key=repr)


def run(spark, events, versions, max_rows):
    e, v = spark.createDataFrame(events, EVENTS), spark.createDataFrame(versions, VERSIONS)
    out = state_asof_join(e, v, "k", "at", "start", ["p", "start", "v"], ["v"], end="end", known="known", max_rows=max_rows)
    return sorted((tuple(r) for r in out.select("id", "v", "known").collect()), key=repr)


@pytest.mark.parametrize("max_rows", [1000, 20])
def test_random_against_brute_force(spark, max_rows):
    rng = random.Random(7)
    keys = ["hot"] * 6 + ["a", "b", "c", None, ""]
    events = [(rng.choice(keys), rng.choice([None, *range(60)]), i) for i in range(300)]
    versions = [(rng.choice(["hot", "hot", "a", "b"]), s := rng.choice([None, *range(55)]), None if s is None or rng.random() < 0.4 else s + rng.randint(-2, 20), rng.randint(0, 3), f"v{i}") for i in range(120)]
    assert run(spark, events, versions, max_rows) == brute(events, versions)


def test_versions_only_open_and_late(spark):
    events = [("hot", t, t) for t in range(100)] + [("x", 5, 200)]
    versions = [("hot", 90, None, 1, "late"), ("hot", 95, None, 0, "weaker")]
    assert run(spark, events, versions, 10) == brute(events, versions)


@pytest.mark.parametrize("which", ["events", "versions", "both"])
def test_empty(spark, which):
    events = [] if which != "versions" else [("a", 1, 1)]
    versions = [] if which != "events" else [("a", 0, None, 1, "v")]
    assert run(spark, events, versions, 10) == brute(events, versions)


def test_clashing_names_are_refused(spark):
    e, v = spark.createDataFrame([("a", 1, "x")], "k string, at bigint, v string"), spark.createDataFrame([("a", 1, 1, 1, "v")], VERSIONS)
    with pytest.raises(ValueError):
        state_asof_join(e, v, "k", "at", "start", ["p"], ["v"])


def test_timeline_resolves_ties_before_the_join():
    keys, times, rows = current_states(["a", "a", "a"], [1, 1, 4], [None, 3, None], [1, 2, 3])
    assert list(zip(times, rows)) == [(1, 1), (3, 0), (4, 2)]


def test_events_with_a_null_key_are_spread(spark):
    from pyspark.sql import functions as F

    events = [(None, i % 7, i) for i in range(1000)] + [("a", 5, 2000)]
    versions = [("a", 1, None, 1, "v")]
    assert run(spark, events, versions, 1000) == brute(events, versions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        e, v = spark.createDataFrame(events, EVENTS), spark.createDataFrame(versions, VERSIONS)
        out = state_asof_join(e, v, "k", "at", "start", ["p"], ["v"], end="end")
        assert max(r["count"] for r in out.where("k is null").groupBy(F.spark_partition_id()).count().collect()) < 800
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("seed", range(3))
def test_an_entity_with_many_versions_and_few_events_is_split(spark, seed):
    from pyspark.sql import functions as F

    rng = random.Random(seed)
    events = [(rng.choice(["hot", "a"]), rng.randrange(420), i) for i in range(60)]
    versions = [("hot", s := rng.randrange(400), rng.choice([None, s + rng.randint(1, 400), 400]), rng.randint(0, 5), f"v{i}") for i in range(600)] + [("a", 3, None, 1, "va")]
    assert run(spark, events, versions, 40) == brute(events, versions)
    from fareline.operators import asof

    e = spark.createDataFrame(events, EVENTS).selectExpr("k __key", "at __t", "id")
    v = spark.createDataFrame(versions, VERSIONS).select(F.col("k").alias("__key"), F.col("start").alias("__start"), F.col("end").alias("__end"), F.struct("p", "v").alias("__order"), "v").where("__end is null or __end > __start")
    cuts = asof._cuts(v, "__start", {"hot": 600}, 40)
    _, spread = asof._time_shards(e, v, cuts, ["v"])
    assert max(r["count"] for r in spread.where("__key = 'hot'").groupBy("__shard").count().collect()) < 150
