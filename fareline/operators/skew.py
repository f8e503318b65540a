"""Joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys kept apart as hot; a key outside the list holds under 1/HOT_KEYS of the rows.
HOT_KEYS = 1024


def hot_keys(df: DataFrame, key: str, max_rows: int) -> tuple[int, dict[str, int]]:
    """Row count, and the keys with more than max(max_rows, rows / HOT_KEYS) rows; see ``hot_keys_of``."""
    return hot_keys_of(df, [key], max_rows)[0]


def hot_keys_of(df: DataFrame, keys: list[str], max_rows: int) -> list[tuple[int, dict[str, int]]]:
    """The same for several key columns, in one pass.

    A mergeable heavy-hitter sketch: no shuffle of keys, and at most HOT_KEYS entries a column reach the
    driver whatever the size of the input. Null keys are not reported.
    """
    tops = [F.expr(f"case when count({k}) > 0 then approx_top_k({k}, {HOT_KEYS}, {HOT_KEYS * 16}) end").alias(f"top_{i}") for i, k in enumerate(keys)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *tops).first()
    limit = max(max_rows, row["n"] // HOT_KEYS)
    return [(row["n"], {x["item"]: x["count"] for x in row[f"top_{i}"] or [] if x["item"] is not None and x["count"] > limit}) for i in range(len(keys))]


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", max_rows: int = 250_000, spread: Column | None = None, hot: tuple[int, dict[str, int]] | None = None) -> DataFrame:
    """Equi join on the text column ``key`` of both sides, hot keys of the left side salted.

    Rows of a hot key are spread over ceil(rows / max_rows) salts by ``spread`` (a hash of the whole
    row unless given); only the right side's rows of those keys are repeated, once per salt. Null keys match
    nothing; with how="left" they stay. ``how``: inner, left, left_semi or left_anti. ``hot``: the result of
    ``hot_keys``, if it is cheaper to count elsewhere.
    """
    _, counts = hot or hot_keys(left, key, max_rows)
    if not counts:
        return left.join(right, key, how)
    salts = {k: -(-n // max_rows) for k, n in counts.items()}
    of = F.create_map([F.lit(x) for pair in salts.items() for x in pair])
    n = F.coalesce(F.try_element_at(of, F.col(key)), F.lit(1))
    spread = spread if spread is not None else F.xxhash64(*[c for c, t in left.dtypes if "map" not in t])
    a = left.withColumn("__salt", F.pmod(spread, n).cast("int"))
    b = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    return a.join(b, [key, "__salt"], how).drop("__salt")
