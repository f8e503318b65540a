import random

import pytest
from pyspark.sql import functions as F

from fareline.operators.ranks import dense_ranks, exact_quantiles, running_sums


@pytest.fixture()
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_running_sums_over_ranges(spark, many_ranges):
    rng = random.Random(1)
    data = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, 1, 2, 3])) for i in range(400)]
    out = running_sums(spark.createDataFrame(data, "g string, i int, w int"), ["g"], [F.asc("i")], "w", "s").collect()
    total = {}
    for g, i, w in sorted(data, key=lambda x: x[1]):
        total[g] = total.get(g, 0) + (w or 0)
        assert next(r.s for r in out if r.i == i) == total[g]


def test_dense_ranks(spark, many_ranges):
    values = [5.0, 7.0, 7.0, None, 1.0, 5.0, None]
    out = dense_ranks(spark.createDataFrame(list(enumerate(values)), "i int, v double"), "v", "rank")
    assert [r["rank"] for r in out.orderBy("i").collect()] == [2, 1, 1, 4, 3, 2, 4]
    assert dense_ranks(spark.createDataFrame([], "v int"), "v", "rank").count() == 0


def test_exact_quantiles(spark, many_ranges):
    rng = random.Random(2)
    data = [(rng.choice(["a", "a", "b", None]), rng.choice([None, *range(50)])) for _ in range(500)]
    out = {r.g: tuple(r)[1:] for r in exact_quantiles(spark.createDataFrame(data, "g string, v int"), ["g"], "v", (0.0, 0.1, 0.5, 1.0)).collect()}
    for g in ("a", "b", None):
        x = sorted(v for k, v in data if k == g and v is not None)
        assert out[g] == tuple(x[max(0, -(-len(x) * p // 10) - 1)] for p in (0, 1, 5, 10))
    whole = sorted(v for _, v in data if v is not None)
    assert exact_quantiles(spark.createDataFrame(data, "g string, v int"), [], "v", (0.5,)).first().q0 == whole[-(-len(whole) // 2) - 1]
    assert exact_quantiles(spark.createDataFrame([], "g string, v int"), ["g"], "v", (0.5,)).count() == 0
