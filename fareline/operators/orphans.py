"""References to records that are missing, deleted or arrive later.

Bloom filters of the parents' keys, deleted ones included, are broadcast. A reference its filter rejects is a
definite orphan and not looked up; only the references it lets pass are verified by an exact join. References
of several fields to several parents go through one scan, one probe and one join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareline.operators.skew import hot_keys

#: Bits of a filter at most (16 MB). Beyond some 11 million keys more orphans pass it and are told by the join. A filter
#: cut into parts would not spare that: to meet its part a reference would have to be shuffled like in the join.
MAX_BITS = 2**27
BITS_PER_KEY = 12
HASHES = 4
#: Parents of at most so many rows, as counted, are broadcast for the exact join; others are shuffled.
BROADCAST_KEYS = 50_000


def _slot_hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit(1))


def _bits(n: int) -> int:
    return min(MAX_BITS, max(1024, 1 << (n * BITS_PER_KEY - 1).bit_length() if n else 0))


def build_filters(keys: list[tuple[DataFrame, int]]) -> list[np.ndarray]:
    """The Bloom filters of frames with a column key and their numbers of rows, as 64-bit words, in one job. Words
    are or-ed before the shuffle, and what reaches the driver is bounded by MAX_BITS a filter; keys may repeat."""
    slots = None
    for i, (df, n) in enumerate(keys):
        a, b = (h.bitwiseAND(F.lit(2**40 - 1)) for h in _slot_hashes(F.col("key")))
        part = df.where("key is not null").select(F.lit(i).alias("i"), F.explode(F.array(*[F.pmod(a + b * j, F.lit(_bits(n))) for j in range(HASHES)])).alias("s"))
        slots = part if slots is None else slots.unionByName(part)
    found = slots.groupBy("i", F.expr("s >>> 6").cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("m")).toPandas()
    out = []
    for i, (_, n) in enumerate(keys):
        own, words = found[found["i"] == i], np.zeros(_bits(n) // 64, dtype=np.int64)
        words[own["w"].to_numpy()] = own["m"].to_numpy()
        out.append(words)
    return out


def might_contain(spark, filters: list[np.ndarray]) -> Callable[[Column, Column], Column]:
    """A function of a key column and the number of a filter: false only if the key is certainly not in it."""
    shared = spark.sparkContext.broadcast(filters)

    @F.pandas_udf("boolean")
    def probe(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        low = np.int64(2**40 - 1)
        for a, b, which in batches:
            x, y, of = a.to_numpy() & low, b.to_numpy() & low, which.to_numpy()
            hit = np.zeros(len(x), dtype=bool)
            for i in np.unique(of).tolist():
                words, at = shared.value[i], np.flatnonzero(of == i)
                own, u, v = np.ones(len(at), dtype=bool), x[at], y[at]
                for j in range(HASHES):
                    s = (u + v * j) % np.int64(len(words) * 64)
                    own &= (words[s >> 6] >> (s & 63)) & 1 == 1
                hit[at] = own
            yield pd.Series(hit)

    return lambda key, which: probe(*_slot_hashes(key), which)


@dataclass(frozen=True)
class Parents:
    """What is known of the keys of a parent table: a row (key, first_seen, listed, gone_at) per key, all keys
    (repeated as they are) and their number."""

    facts: DataFrame
    keys: DataFrame
    bound: int


def parents_of(table: DataFrame, key: str, seen_at: str | None, deleted: DataFrame) -> Parents:
    """``deleted``: (key, deleted_at). Keys of both are in the filter, so a key it rejects is neither listed
    nor deleted. first_seen is null without ``seen_at``. Null and empty keys are none."""
    seen = F.col(seen_at) if seen_at else F.lit(None).cast("timestamp_ntz")
    listed = table.select(F.col(key).alias("key"), seen.alias("first_seen"), F.lit(True).alias("listed"))
    gone = deleted.where("deleted_at is not null").select("key", F.col("deleted_at").alias("gone_at"))
    both = listed.unionByName(gone, allowMissingColumns=True).where("key is not null and key != ''")
    facts = both.groupBy("key").agg(F.min("first_seen").alias("first_seen"), F.max("listed").alias("listed"), F.min("gone_at").alias("gone_at"))
    return Parents(facts, both.select("key"), table.count() + deleted.count())


def orphan_references(references: DataFrame, parents: Parents | dict[str, Parents], max_rows: int = 250_000) -> DataFrame:
    """The references that fail, with the first reason that applies.

    references: columns key, at (a timestamp, or null: no time, any deletion counts and nothing is late), parent
    (a name in ``parents``, if that is a dict; others are refused by giving no row) and what else is to be kept.
    Adds reason: 'deleted' (deleted at or before ``at``), 'missing', 'late' (first seen after ``at``). Null and
    empty keys are no references. Repeated references come out as often as they go in. Names of
    ``Parents.facts`` among the kept columns are refused (ValueError).

    Parents of at most BROADCAST_KEYS rows together are broadcast; references to others are shuffled if their
    filter lets them pass, those to hot keys (over max_rows references) in salts.
    """
    if clash := {"first_seen", "listed", "gone_at", "reason"} & set(references.columns):
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    several = isinstance(parents, dict)
    named = parents if several else {"": parents}
    names, small, room = list(named), [], BROADCAST_KEYS
    for name in sorted(names, key=lambda n: named[n].bound):
        if named[name].bound <= room:
            small.append(name)
            room -= named[name].bound
    large = [n for n in names if n not in small]
    probe = might_contain(references.sparkSession, build_filters([(named[n].keys, named[n].bound) for n in names]))
    refs = references.where("key is not null and key != ''").withColumn("__of", F.col("parent") if several else F.lit(""))
    which = F.coalesce(*[F.when(F.col("__of") == n, F.lit(i)) for i, n in enumerate(names)])
    refs = refs.withColumn("__which", which.cast("int")).where("__which is not null")
    of_large = F.col("__which").isin([names.index(n) for n in large]) if large else F.lit(False)

    def reason(p: str) -> Column:
        listed, first_seen, gone_at = (F.col(f"{p}{c}") for c in ("listed", "first_seen", "gone_at"))
        gone = gone_at.isNotNull() & (F.col("at").isNull() | (gone_at <= F.col("at")))
        return F.when(gone, "deleted").when(listed.isNull(), "missing").when(listed & (first_seen > F.col("at")), "late")

    def facts(of: list[str], p: str) -> DataFrame:
        out = None
        for n in of:
            part = named[n].facts.select(F.lit(names.index(n)).alias(f"{p}which"), F.col("key").alias(f"{p}key"), *[F.col(c).alias(f"{p}{c}") for c in ("first_seen", "listed", "gone_at")])
            out = part if out is None else out.unionByName(part)
        return out

    rows = refs.withColumn("__known", probe(F.col("key"), F.col("__which")))
    kept = references.columns
    if small:
        # a key that the filter rejects is not looked up and has no facts
        rows = rows.withColumns({"__a_which": F.when(F.col("__known"), F.col("__which")), "__a_key": F.col("key")}).join(F.broadcast(facts(small, "__a_")), ["__a_which", "__a_key"], "left")
        first = reason("__a_")
    else:
        first = F.lit("missing")
    pending = F.col("__known") & of_large
    rows = rows.withColumn("__reason", F.when(~pending, first)).withColumn("__pending", pending).where("__pending or __reason is not null")
    if not large:
        return rows.select(*kept, F.col("__reason").alias("reason"))
    # what waits is looked up by key and salt; what is decided has a null key and goes anywhere
    hot = hot_keys(refs.where(of_large).select(F.concat_ws("\x1f", "__which", "key").alias("k")), "k", max_rows)[1]
    of = F.create_map([F.lit(x) for k, n in hot.items() for x in (k, -(-n // max_rows))]) if hot else None

    def salts(which: str, key: str) -> Column:
        return F.coalesce(F.try_element_at(of, F.concat_ws("\x1f", which, key)), F.lit(1)) if hot else F.lit(1)

    spread = F.xxhash64(*[c for c, t in references.dtypes if "map<" not in t])  # taken of few rows
    n = salts("__which", "key")
    salt = F.when(~F.col("__pending"), F.pmod(spread, F.lit(4096))).when(n > 1, F.pmod(spread, n)).otherwise(0).cast("int")
    left = rows.select(*kept, "__reason", F.when(F.col("__pending"), F.col("__which")).alias("__b_which"), F.when(F.col("__pending"), F.col("key")).alias("__b_key"), salt.alias("__salt"))
    right = facts(large, "__b_").withColumn("__salt", F.explode(F.sequence(F.lit(0), (salts("__b_which", "__b_key") - 1).cast("int"))))
    out = left.join(right, ["__b_which", "__b_key", "__salt"], "left")
    return out.withColumn("__reason", F.when(F.col("__b_key").isNull(), F.col("__reason")).otherwise(reason("__b_"))).where("__reason is not null").select(*kept, F.col("__reason").alias("reason"))
