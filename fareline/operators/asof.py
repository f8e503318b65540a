"""Attributes as known at event time: a bitemporal as-of join.

Versions become *available* at an instant; of the versions available at an event, the one first in a
priority order counts. Both sides are hash-partitioned by entity into buckets; inside a bucket the versions
are turned into a timeline of current states (one row per entity and availability instant, ties resolved
beforehand) and an embedded DuckDB runs an ASOF LEFT JOIN of the events against it.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareline.operators.skew import hot_keys
from fareline.session import shuffle_partitions

BEFORE_ALL = -(2**62)


def current_states(keys: list, starts: list, ends: list, order: list) -> tuple[list[int], list[int], list[int]]:
    """Timeline of the entities as parallel lists (row giving the key, instant, row in force or -1).

    Rows must be sorted by key, then start. From a start to its end (exclusive, None = open) a row is in
    force unless a row with a greater ``order`` is. One entry per key and instant at which the state changes.
    """
    at_key, at_time, at_row = [], [], []
    i, n = 0, len(keys)
    while i < n:
        j, key, heap, last = i, keys[i], [], None
        while j < n and keys[j] == key:
            j += 1
        bounds = sorted({*starts[i:j], *(e for e in ends[i:j] if e is not None)})
        row = i
        for t in bounds:
            while row < j and starts[row] <= t:
                heapq.heappush(heap, (-order[row], row))
                row += 1
            while heap and (e := ends[heap[0][1]]) is not None and e <= t:
                heapq.heappop(heap)
            state = heap[0][1] if heap else -1
            if state != last:
                at_key.append(i)
                at_time.append(t)
                at_row.append(state)
                last = state
        i = j
    return at_key, at_time, at_row


def _bucket_join(payload: Sequence[str], out: pa.Schema):
    def run(events: pa.Table, versions: pa.Table) -> pa.Table:
        import duckdb

        with duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""}) as db:
            db.register("events", events)
            db.register("versions", versions)
            # __rank: the priority order as one number
            v = db.sql("SELECT *, row_number() OVER (ORDER BY __order NULLS FIRST) AS __rank FROM versions ORDER BY __shard, __key, __start").to_arrow_table()
            shards, keys = v["__shard"].to_pylist(), v["__key"].to_pylist()
            k, t, row = current_states(list(zip(shards, keys)), v["__start"].to_pylist(), v["__end"].to_pylist(), v["__rank"].to_pylist())
            states = pa.table({"__shard": pa.array([shards[x] for x in k], pa.int32()), "__key": pa.array([keys[x] for x in k], pa.string()), "__at": pa.array(t, pa.int64())})
            taken = v.select(list(payload)).take(pa.array([x if x >= 0 else None for x in row], pa.int64()))
            for name in payload:
                states = states.append_column(name, taken[name])
            db.register("states", states)
            db.register("known", v.select(["__key"]))
            kept = [f'e."{c}"' for c in events.column_names if not c.startswith("__")]
            return db.sql(
                f"SELECT {', '.join(kept + [f's."{c}"' for c in payload])}, coalesce(e.__key IN (SELECT __key FROM known), false) AS __known FROM events e ASOF LEFT JOIN states s ON e.__shard = s.__shard AND e.__key = s.__key AND e.__t >= s.__at"
            ).to_arrow_table().cast(out)

    return run


def state_asof_join(events: DataFrame, versions: DataFrame, key: str, at: str, start: str, order: Sequence[str], payload: Sequence[str], end: str | None = None, known: str | None = None, max_rows: int = 250_000, hot: tuple[int, dict[str, int]] | None = None, most_versions: int | None = None) -> DataFrame:
    """Each event with the ``payload`` columns of the version in force at ``events[at]``.

    key: text column of both sides. at, start, end: bigint columns on one scale; a version is available from
    start up to end (exclusive; null or absent = for ever). order: of several the version with the greatest
    tuple counts. known: name of an added boolean, whether the key has any version. Events with a null key or
    time get nulls; versions with a null key or start never apply. Empty inputs give empty or null results.
    Payload names must not occur among the events' columns (ValueError). ``hot``: the result of ``hot_keys`` for
    the key, if it was counted before; ``most_versions``: a proven bound of the versions, which spares their count
    if no key can have over max_rows of them.

    Skew: entities with over max_rows events or versions are split into time shards at approximate quantiles of
    their own events and of the starts and ends of their versions. A version goes to the shards it begins and ends
    in; of those that cover a shard whole only the best goes there. So neither side of an entity meets in one
    task. Events with a null key are spread over all tasks by a hash of the row.
    """
    if clash := {*payload, known} & set(events.columns):
        raise ValueError(f"columns on both sides: {sorted(map(str, clash))}")
    spark = events.sparkSession
    e = events.withColumns({"__key": F.col(key), "__t": F.col(at)})
    v = versions.select(F.col(key).alias("__key"), F.col(start).alias("__start"), (F.col(end) if end else F.lit(None)).cast("long").alias("__end"), F.struct(*order).alias("__order"), *payload)
    v = v.where("__key is not null and __start is not null and (__end is null or __end > __start)")
    total, counts = hot or hot_keys(e, "__key", max_rows)
    few = most_versions is not None and most_versions <= max_rows
    versions_total, versions_counts = (most_versions, {}) if few else hot_keys(v, "__key", max_rows)
    if not counts and not versions_counts:
        e, v = e.withColumn("__shard", F.lit(0)), v.withColumn("__shard", F.lit(0))
    else:
        most = max(max_rows, total // 4096, versions_total // 2048)
        cuts = [_cuts(e, "__t", counts, most), _cuts(v, "__start", versions_counts, most), _cuts(v, "__end", versions_counts, most)]
        e, v = _time_shards(e, v, {k: sorted({x for c in cuts for x in c.get(k, ())}) for k in {k for c in cuts for k in c}}, payload)
    n = max(shuffle_partitions(spark), -(-max(total, versions_total) // max_rows))
    bucket = F.pmod(F.xxhash64("__key", "__shard"), F.lit(n)).alias("__b")
    # events with a null key need no versions: any bucket, by a hash of the row
    any_bucket = F.pmod(F.xxhash64(*[c for c, kind in events.dtypes if "map<" not in kind and "variant" not in kind]), F.lit(n))
    event_bucket = F.when(F.col("__key").isNull(), any_bucket).otherwise(bucket).alias("__b")
    fields = [*events.schema.fields, *(versions.schema[c] for c in payload)]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BooleanType, StructField, StructType

    schema = StructType([*fields, StructField("__known", BooleanType())])
    run = _bucket_join(tuple(payload), to_arrow_schema(schema))
    joined = e.select("*", event_bucket).groupBy("__b").cogroup(v.select("*", bucket).groupBy("__b")).applyInArrow(run, schema)
    return joined.withColumnRenamed("__known", known) if known else joined.drop("__known")


def _cuts(df: DataFrame, at: str, hot: dict[str, int], max_rows: int) -> dict[str, list[int]]:
    """Quantiles of the hot keys' times, at most one per max_rows rows."""
    if not hot:
        return {}
    steps = {k: -(-n // max_rows) for k, n in hot.items()}
    of = 256 if max(steps.values()) <= 256 else 4096
    points = ", ".join(str(i / of) for i in range(1, of))
    found = df.where(F.col("__key").isin(list(hot))).groupBy("__key").agg(F.expr(f"percentile_approx({at}, array({points}), 20000)").alias("q")).collect()
    return {r["__key"]: sorted({r["q"][max(0, round(of * i / steps[r["__key"]]) - 1)] for i in range(1, steps[r["__key"]])}) for r in found if r["q"]}


def _time_shards(e: DataFrame, v: DataFrame, cuts: dict[str, list[int]], payload: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    side = e.sparkSession.createDataFrame([(k, c) for k, c in cuts.items() if c], "__key string, __cuts array<bigint>")

    def shard(t):
        return F.coalesce(F.size(F.filter("__cuts", lambda b: b <= t)), F.lit(0))

    e = e.join(F.broadcast(side), "__key", "left").withColumn("__shard", shard(F.coalesce("__t", F.lit(BEFORE_ALL)))).drop("__cuts")
    v = v.join(F.broadcast(side), "__key", "left").withColumn("__cuts", F.coalesce("__cuts", F.expr("cast(array() as array<bigint>)")))
    # covered whole: the shards between __shard and __last; the last shard of an open version is covered as well
    own = v.withColumns({"__shard": shard(F.col("__start")), "__last": F.when(F.col("__end").isNull(), F.size("__cuts") + 1).otherwise(shard(F.col("__end") - 1))})
    whole, fields = F.struct("__order", "__start", "__end", *payload), ("__start", "__end", "__order", *payload)
    unpacked = ["__key", *[F.col(f"b.{c}").alias(c) for c in fields], "__shard"]
    # of those that are in force when a shard begins and end in it at one instant, the best
    ending = own.where("__end is not null and __last > __shard").groupBy("__key", F.col("__last").alias("__shard"), F.col("__end").alias("e")).agg(F.max_by(whole, "__order").alias("b")).select(*unpacked)
    # of those that cover a shard, the best: as aligned blocks of 2**level shards, aggregated before they are spread
    levels = max((len(c) + 1 for c in cuts.values()), default=1).bit_length()
    inner = own.where("__shard + 1 < __last").select("__key", "__order", whole.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("l"), "__shard", "__last")
    inner = inner.withColumns({"x": F.expr("shiftright(__shard + shiftleft(1, l), l)"), "y": F.expr("shiftright(__last, l)")})
    blocks = inner.withColumn("i", F.explode(F.expr("array_compact(array(if(x < y and x % 2 = 1, x, null), if(x < y and y % 2 = 1, y - 1, null)))")))
    best = blocks.groupBy("__key", "l", "i").agg(F.max_by("b", "__order").alias("b"))
    spread = best.select("__key", "b", F.explode(F.expr("sequence(shiftleft(i, l), shiftleft(i + 1, l) - 1)")).alias("__shard"))
    covering = spread.groupBy("__key", "__shard").agg(F.max_by("b", F.col("b.__order")).alias("b")).select(*unpacked)
    # a row without values in every shard of a key that has versions: the key is known there too
    grid = side.select("__key", F.explode(F.sequence(F.lit(0), F.size("__cuts"))).alias("__shard"))
    marks = grid.join(own.select("__key").distinct(), "__key", "left_semi").select("__key", F.lit(BEFORE_ALL).alias("__start"), "__shard")
    starting = own.drop("__last", "__cuts")
    return e, starting.unionByName(ending).unionByName(covering).unionByName(marks, allowMissingColumns=True)
