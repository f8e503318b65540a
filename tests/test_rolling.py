import datetime as dt
import random

import pytest

from fareline.operators.rolling import rolling_totals

DDL = "e string, day date, b int, loaded int"
DAY = dt.date(2024, 1, 1)


def brute(data, windows):
    best = {}
    for e, d, b, v in data:
        if e and d:
            key = (v is not None, v or 0, b is not None, b or 0)
            if (e, d) not in best or key > best[e, d][0]:
                best[e, d] = (key, b)
    out = []
    for e in {k[0] for k in best}:
        days = [d for x, d in best if x == e]
        first, last = min(days), max(days)
        for i in range((last - first).days + 1):
            d = first + dt.timedelta(i)
            value = best.get((e, d), (0, None))[1]
            row = [e, d, value]
            for w in windows:
                total = sum((best.get((e, d - dt.timedelta(j)), (0, 0))[1] or 0) for j in range(min(w, i + 1)))
                row += [total, total / min(w, i + 1)]
            out.append(tuple(row))
    return sorted(out, key=repr)


@pytest.mark.parametrize("windows", [(7, 30), (1, 2), (5,), (11, 13, 17)])
def test_random_against_brute_force(spark, windows):
    rng = random.Random(3)
    data = [(rng.choice(["a", "a", "b", "", None]), rng.choice([None, *[DAY + dt.timedelta(x) for x in rng.sample(range(900), 40)]]), rng.choice([None, 0, 5, 9, -3]), rng.choice([None, 1, 2])) for _ in range(400)]
    data += data[:20]
    out = rolling_totals(spark.createDataFrame(data, DDL), "e", "day", "b", windows, "loaded")
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(data, windows)


def test_one_day_and_none(spark):
    one = rolling_totals(spark.createDataFrame([("a", DAY, None, 1)], DDL), "e", "day", "b", (7,), "loaded")
    assert [tuple(r) for r in one.collect()] == [("a", DAY, None, 0, 0.0)]
    assert rolling_totals(spark.createDataFrame([], DDL), "e", "day", "b").count() == 0
