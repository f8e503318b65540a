"""Continuous periods, overlaps and gaps of intervals, from run bitmaps.

Time is cut into exact units and these into shards. Per entity and shard two bitmaps are kept: units covered
by anything, and units covered by two different sources. They are compressed to runs (start, length, ...) and
united in NumPy, a batch at a time: runs become steps up and down, and where the running sum is at least 1 a
unit is set. Shards that an interval covers whole are not written out: it marks the first of them and the one
after the last, if it has an end.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units in a shard.
SHARD = 1024
#: Runs that a task gathers before it passes them on.
HELD = 200_000
#: The shard after the last one of an interval without end.
NEVER = 2**52
NONE = -(2**63)

_LOCAL = "entity string, source string, shard long, covered array<int>, until long"
_UNITED = "entity string, shard long, covered array<int>, twice array<int>, change int"
_PERIODS = "entity string, lo bigint, hi bigint, shared boolean, next_lo bigint"

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def levels(group: np.ndarray, at: np.ndarray, step: np.ndarray) -> Runs:
    """(group, position, sum of the steps up to there) for each position of a group at which there is a step."""
    if not len(group):
        return group, at, step
    order = np.lexsort((at, group))
    group, at, step = group[order], at[order], step[order]
    first = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (at[1:] != at[:-1]))))
    group, at, total = group[first], at[first], np.cumsum(np.add.reduceat(step, first))
    fresh = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    before = np.concatenate(([0], total))[fresh]  # what earlier groups left open
    return group, at, total - np.repeat(before, np.diff(np.concatenate((fresh, [len(group)]))))


def runs_at(group: np.ndarray, at: np.ndarray, level: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, start, end, index of the start) of the runs over which the level is at least ``least``. The end of a
    run that its group never closes is NONE."""
    on = level >= least
    fresh = np.concatenate(([True], group[1:] != group[:-1])) if len(group) else np.zeros(0, dtype=bool)
    before = np.concatenate(([False], on[:-1])) & ~fresh if len(group) else on
    start = np.flatnonzero(on & ~before)
    # the next place that is off, or the end of the group
    stop = np.concatenate((np.flatnonzero(~on | fresh), [len(group)]))
    end = stop[np.searchsorted(stop, start, side="right")] if len(start) else start
    inside = np.minimum(end, max(len(group) - 1, 0))
    closed = (end < len(group)) & (group[inside] == group[start]) if len(start) else on[:0]
    return group[start], at[start], np.where(closed, at[inside], NONE) if len(start) else at[:0], start


def to_lists(n: int, group: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.ListArray:
    """Run lists of the groups 0 to n - 1; groups ascend."""
    offsets = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=n) * 2)))
    values = np.empty(2 * len(start), dtype=np.int32)
    values[0::2], values[1::2] = start, length
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def from_lists(lists: pa.Array) -> Runs:
    """(row, start, length) of the runs of a column of run lists."""
    n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)) // 2
    values = np.asarray(lists.flatten())
    return np.repeat(np.arange(len(lists)), n), values[0::2].astype(np.int64), values[1::2].astype(np.int64)


def _steps(group: np.ndarray, start: np.ndarray, length: np.ndarray) -> Runs:
    return np.concatenate((group, group)), np.concatenate((start, start + length)), np.concatenate((np.ones(len(start), np.int64), np.full(len(start), -1)))


def _codes(column: pa.Array) -> np.ndarray:
    """Numbers for the values of a column."""
    return np.asarray(column.dictionary_encode().indices).astype(np.int64)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each row, a row of each group) by equal keys; groups ascend by the keys from the first on."""
    order = np.lexsort(keys[::-1])
    fresh = np.zeros(len(order), dtype=bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= k[order][1:] != k[order][:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(fresh) - 1
    return group, order[fresh]


def _local_bitmaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps per entity, source and shard of the rows of a batch, before any shuffle."""
    for batch in batches:
        if not batch.num_rows:
            continue
        entity, source = _codes(batch.column(0)), _codes(batch.column(1))
        lo, open_ = np.asarray(batch.column(2)), np.asarray(batch.column(3).is_null())
        hi = np.where(open_, lo + 1, np.asarray(pc.fill_null(batch.column(3), 0)))
        first, last = lo // SHARD, np.where(open_, NEVER, (hi - 1) // SHARD)
        far = last > first + 2
        pieces = np.where(open_, 1, np.where(far, 2, last - first + 1))
        row = np.repeat(np.arange(len(lo)), pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        shard = np.where(far[row] & (nth == 1), last[row], first[row] + nth)
        a = np.maximum(lo[row] - shard * SHARD, 0)
        b = np.where(open_[row], SHARD, np.minimum(hi[row] - shard * SHARD, SHARD))
        group, some = _groups(entity[row], source[row], shard)
        g, start, end, _ = runs_at(*levels(*_steps(group, a, b - a)), 1)
        spans, one = _groups(entity[far], source[far], first[far], last[far])
        whole = np.flatnonzero(far)[one]
        covered = pa.concat_arrays([to_lists(len(some), g, start, end - start), pa.array([[]] * len(whole), pa.list_(pa.int32()))])
        take = pa.array(np.concatenate((row[some], whole)))
        until = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(last[whole], pa.int64())])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate((shard[some], first[whole] + 1)), pa.int64()), covered, until], names=["entity", "source", "shard", "covered", "until"])


def _whole_groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The sorted rows again, no group of equal first columns cut in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        n, last = batch.num_rows, None
        differs = np.zeros(n, dtype=bool)
        for i in range(keys):
            c = batch.column(i)
            differs[1:] |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, n - 1)))
        if held:
            last = held[-1]
            differs[0] = any(batch.column(i)[0].as_py() != last.column(i)[last.num_rows - 1].as_py() for i in range(keys))
        cut = np.flatnonzero(differs)
        if not len(cut):
            held.append(batch)
            continue
        whole = [*held, batch.slice(0, int(cut[-1]))]
        if sum(b.num_rows for b in whole):
            yield pa.Table.from_batches(whole).combine_chunks()
        held = [batch.slice(int(cut[-1]))]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(t: pa.Table, i: int) -> pa.Array:
    c = t.column(i)
    return c.chunk(0) if c.num_chunks == 1 else c.combine_chunks()


def _one_source_each(t: pa.Table) -> tuple[pa.Array, Runs, Runs]:
    """Entities, and by their rows the runs (row, shard * SHARD + start, length) and the changes (row, shard, +1 or
    -1) of whole sources, sorted by entity, source, shard; spans before bitmaps.

    Bitmaps inside a span of their own source are dropped, and spans of a source that meet are one.
    """
    entity, source, shard = _column(t, 0), _column(t, 1), np.asarray(_column(t, 2))
    group, _ = _groups(_codes(entity), _codes(source))
    span = np.asarray(_column(t, 4).is_valid())
    until = np.asarray(pc.fill_null(_column(t, 4), 0))
    ends, rank = np.unique(np.where(span, until, NONE), return_inverse=True)
    order = np.lexsort((~span, shard, group))
    reach = np.empty(len(order), dtype=np.int64)  # how far the spans of the source reach that began so far
    reach[order] = ends[np.maximum.accumulate(group[order] * len(ends) + np.where(span, rank, 0)[order]) - group[order] * len(ends)]
    kept = np.flatnonzero(~span & (shard >= reach))
    of, start, length = from_lists(_column(t, 3).take(pa.array(kept)))
    one, some = _groups(group[kept], shard[kept])
    g, a, b, _ = runs_at(*levels(*_steps(one[of], start, length)), 1)
    runs = (kept[some][g], shard[kept][some][g] * SHARD + a, b - a)
    s = order[span[order]]
    before = np.concatenate(([NONE], reach[s][:-1])) if len(s) else s
    fresh = np.ones(len(s), dtype=bool)
    fresh[1:] = (group[s][1:] != group[s][:-1]) | (shard[s][1:] > before[1:])
    closing = np.concatenate((np.flatnonzero(fresh)[1:] - 1, [len(s) - 1])) if len(s) else s
    over = closing[reach[s][closing] != NEVER] if len(s) else closing
    changes = (np.concatenate((s[fresh], s[over])), np.concatenate((shard[s][fresh], reach[s][over])), np.concatenate((np.ones(int(fresh.sum()), np.int64), np.full(len(over), -1))))
    return entity, runs, changes


def _unite_sources(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by entity, source and shard. All bitmaps of a source of an entity come to one task, and of each
    of its shards into one row, so the rows that come out have no source in common."""
    held: list[tuple[pa.Array, Runs, Runs]] = []

    def flush() -> pa.RecordBatch:
        names = pa.concat_arrays([e for e, _, _ in held]).dictionary_encode()
        code, base = np.asarray(names.indices).astype(np.int64), np.cumsum([0, *(len(e) for e, _, _ in held)])
        runs = [np.concatenate([r[i] + (base[j] if i == 0 else 0) for j, (_, r, _) in enumerate(held)]) for i in range(3)]
        changes = [np.concatenate([c[i] + (base[j] if i == 0 else 0) for j, (_, _, c) in enumerate(held)]) for i in range(3)]
        held.clear()
        n, shard = len(runs[0]), np.concatenate((runs[1] // SHARD, changes[1]))
        entity = np.concatenate((code[runs[0]], code[changes[0]]))
        group, some = _groups(entity, shard)
        level = levels(*_steps(group[:n], runs[1] % SHARD, runs[2]))
        lists = []
        for least in (1, 2):
            g, a, b, _ = runs_at(*level, least)
            lists.append(to_lists(len(some), g, a, b - a))
        change = np.bincount(group[n:], weights=changes[2], minlength=len(some)).astype(np.int32)
        return pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(entity[some])), pa.array(shard[some], pa.int64()), *lists, pa.array(change)], names=["entity", "shard", "covered", "twice", "change"])

    for t in _whole_groups(batches, 2):
        held.append(_one_source_each(t))
        if sum(len(r[0]) + len(c[0]) for _, r, c in held) > HELD:
            yield flush()
    if held:
        yield flush()


def _periods(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by entity: the set runs over all shards are its periods, the clear ones between them the gaps."""
    for t in _whole_groups(batches, 1):
        names = _column(t, 0).dictionary_encode()
        entity, base = np.asarray(names.indices).astype(np.int64), np.asarray(_column(t, 1)) * SHARD
        change = np.asarray(_column(t, 4)).astype(np.int64)
        parts = [(entity, base, change)]
        for i in (2, 3):  # a unit covered twice counts once more
            row, start, length = from_lists(_column(t, i))
            parts.append(_steps(entity[row], base[row] + start, length))
        group, at, level = levels(*(np.concatenate([x[i] for x in parts]) for i in range(3)))
        g, lo, hi, first = runs_at(group, at, level, 1)
        if not len(g):
            continue
        shared = np.maximum.reduceat(level, first) > 1
        last = np.concatenate((g[1:] != g[:-1], [True]))
        following = np.concatenate((lo[1:], [0]))
        yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(g)), pa.array(lo, pa.int64()), pa.array(hi, pa.int64(), mask=hi == NONE), pa.array(shared), pa.array(following, pa.int64(), mask=last)], names=["entity", "lo", "hi", "shared", "next_lo"])


def continuous_periods(intervals: DataFrame) -> DataFrame:
    """(entity, lo, hi, shared, next_lo, open): the continuous periods [lo, hi) of each entity.

    intervals: entity string, source string, lo bigint, hi bigint (exclusive; null = no end), in whole units
    within 2**61 of 0. shared: two different sources share a unit of the period. next_lo: start of the entity's
    next period, so [hi, next_lo) is a gap; null after the last. open: the period has no end (hi is null). Rows
    with a null entity or lo, or that cover no unit, are left out; a null source is a source like any other.

    Skew: rows become bitmaps before the first shuffle, which is by entity and source, so an entity with a
    third of all rows is united in every task; the second shuffle carries at most one pair of bitmaps per HELD runs
    of a task, entity and shard. An interval costs at most three bitmaps, however long it is. A task holds HELD runs
    and the rows of one source (the periods: of one entity, united) at a time; the sorts are Spark's and spill.
    """
    rows = intervals.where("entity is not null and lo is not null and (hi is null or hi > lo)").select("entity", F.coalesce("source", F.lit("\0")).alias("source"), "lo", "hi")
    local = rows.mapInArrow(_local_bitmaps, _LOCAL).repartition("entity", "source").sortWithinPartitions("entity", "source")
    merged = local.mapInArrow(_unite_sources, _UNITED).repartition("entity").sortWithinPartitions("entity").mapInArrow(_periods, _PERIODS)
    return merged.withColumn("open", F.col("hi").isNull())
