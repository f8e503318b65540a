import random

import pytest

from fareline.operators import intervals as I

DDL = "entity string, source string, lo bigint, hi bigint"


def brute(data):
    out, top = [], 10_000
    for e in {x[0] for x in data if x[0] is not None}:
        units = {}
        for _, s, lo, hi in [x for x in data if x[0] == e and x[2] is not None]:
            for u in range(lo, top if hi is None else hi):
                units.setdefault(u, set()).add(s)
        periods = []
        for u in sorted(units):
            if periods and periods[-1][1] == u:
                periods[-1] = (periods[-1][0], u + 1, periods[-1][2] or len(units[u]) > 1)
            else:
                periods.append((u, u + 1, len(units[u]) > 1))
        for i, (lo, hi, shared) in enumerate(periods):
            out.append((e, lo, None if hi == top else hi, shared, periods[i + 1][0] if i + 1 < len(periods) else None, hi == top))
    return sorted(out, key=repr)


def run(spark, data):
    out = I.continuous_periods(spark.createDataFrame(data, DDL))
    return sorted(((r.entity, r.lo, None if r.open else r.hi, r.shared, r.next_lo, r.open) for r in out.collect()), key=repr)


@pytest.mark.parametrize("shard", [8, 1024])
@pytest.mark.parametrize("seed", range(6))
def test_random_against_brute_force(spark, monkeypatch, shard, seed):
    monkeypatch.setattr(I, "SHARD", shard)
    rng = random.Random(seed)
    data = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.choice(["s", "t", "u", "v", None]), lo := rng.choice([None, *range(-40, 900)]), None if lo is None or rng.random() < 0.06 else lo + rng.choice([-2, 0, 1, 3, 8, 12, 40, 90, 150])) for _ in range(rng.choice([20, 60]))]
    data += data[:10]
    if shard == 8:  # the workers see the module as it is on disk, so run the steps here
        assert _here(data) == brute(data)
    else:
        assert run(spark, data) == brute(data)


def _here(data):
    import pyarrow as pa

    rows = [(e, s or "\0", lo, hi) for e, s, lo, hi in data if e is not None and lo is not None and (hi is None or hi > lo)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["entity", "source", "lo", "hi"])
    local = pa.Table.from_batches(I._local_bitmaps([batch]))
    united = pa.Table.from_batches(I._unite_sources(local.sort_by([("entity", "ascending"), ("source", "ascending")]).to_batches(max_chunksize=7))).sort_by([("entity", "ascending")])
    out = pa.Table.from_batches(I._periods(united.to_batches(max_chunksize=5))).to_pylist()
    return sorted(((r["entity"], r["lo"], r["hi"], r["shared"], r["next_lo"], r["hi"] is None) for r in out), key=repr)


def test_runs_of_levels():
    import numpy as np

    group, at, level = I.levels(np.array([0, 0, 1, 1, 0, 0]), np.array([3, 5, 2, 4, 5, 9]), np.array([1, -1, 1, 1, 1, -1]))
    assert list(zip(group, at, level)) == [(0, 3, 1), (0, 5, 1), (0, 9, 0), (1, 2, 1), (1, 4, 2)]
    g, a, b, _ = I.runs_at(group, at, level, 1)
    assert list(zip(g, a, b)) == [(0, 3, 9), (1, 2, I.NONE)]
    none = np.zeros(0, dtype=np.int64)
    assert [len(x) for x in I.runs_at(*I.levels(none, none, none), 1)] == [0, 0, 0, 0]
    lists = I.to_lists(3, np.array([0, 2, 2]), np.array([1, 4, 9]), np.array([2, 3, 1]))
    assert lists.to_pylist() == [[1, 2], [], [4, 3, 9, 1]]
    assert [x.tolist() for x in I.from_lists(lists)] == [[0, 2, 2], [1, 4, 9], [2, 3, 1]]


@pytest.mark.parametrize("held", [1, 40])
def test_small_tasks(monkeypatch, held):
    monkeypatch.setattr(I, "SHARD", 8)
    monkeypatch.setattr(I, "HELD", held)
    rng = random.Random(held)
    data = [(rng.choice("ab"), rng.choice("stuv"), lo := rng.randrange(400), None if rng.random() < 0.03 else lo + rng.choice([1, 5, 30, 90])) for _ in range(150)]
    assert _here(data) == brute(data)


def test_touching_and_far(spark):
    data = [("a", "x", 0, 5), ("a", "x", 5, 9), ("a", "y", 9, 12), ("a", "z", 100_000, 100_001), ("b", "x", 3, 3)]
    assert run(spark, data) == [("a", 0, 12, False, 100_000, False), ("a", 100_000, 100_001, False, None, False)]
    assert run(spark, []) == []
    ages = [("a", "x", 0, 3_000_000), ("a", "x", 2_000_000, 5_000_000), ("a", "y", 6_000_000, 9_000_000), ("b", "x", 0, 4_000_000), ("b", "y", 3_999_999, None)]
    assert run(spark, ages) == [("a", 0, 5_000_000, False, 6_000_000, False), ("a", 6_000_000, 9_000_000, False, None, False), ("b", 0, None, True, None, True)]
