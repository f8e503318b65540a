"""Joins that are more than an equality of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareline.operators.asof import state_asof_join


def measured_left_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row: left rows, rows of the left join and left rows without a partner.

    The join itself is not carried out: the right side is counted by key, so a key that is frequent on both
    sides costs no more rows than it has on the left.
    """
    n = right.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    found = left.select(*on).join(n, list(on), "left")
    return found.agg(F.count(F.lit(1)).alias("left_rows"), F.coalesce(F.sum(F.coalesce("__n", F.lit(1))), F.lit(0)).alias("output_rows"), F.count(F.when(F.col("__n").isNull(), 1)).alias("orphans"))


def unambiguous_lookup(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of the keys with exactly one distinct non-null value."""
    rows = df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    return rows.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("__max")).where(F.col(value) == F.col("__max")).drop("__max")


def latest_rows(df: DataFrame, group: Sequence[str], at: str, tie: str) -> DataFrame:
    """The latest row of each group; of equal times the greatest ``tie``. Aggregates before the shuffle."""
    rest = [c for c in df.columns if c not in group]
    return df.groupBy(*group).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("__r")).select(*group, *[F.col(f"__r.{c}").alias(c) for c in rest])


def smallest_fit(needs: DataFrame, need: str, sizes: DataFrame, size: str, label: str) -> DataFrame:
    """Each row with the smallest size of at least its need and the label of it (least label of equal sizes).

    The inequality join as an as-of join on the negated axis: the size in force at -need is the greatest
    -size not above it. Values are compared to six decimals. Null needs and needs above all sizes get nulls.
    """
    def axis(column: str) -> Column:
        return -F.round(F.col(column).cast("double") * 1e6).cast("long")

    one = sizes.where(F.col(size).isNotNull()).groupBy(size).agg(F.min(label).alias(label))
    versions = one.select(F.lit("all").alias("__all"), axis(size).alias("__from"), size, label)
    events = needs.withColumns({"__all": F.lit("all"), "__need": axis(need)}).withColumnsRenamed({c: f"need_{c}" for c in (size, label) if c in needs.columns})
    out = state_asof_join(events.withColumnsRenamed({"__all": "fit_key", "__need": "fit_at"}), versions.withColumnsRenamed({"__all": "fit_key", "__from": "fit_from"}), "fit_key", "fit_at", "fit_from", ["fit_from"], [size, label])
    return out.drop("fit_key", "fit_at")


def mismatches(stored: DataFrame, fresh: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows whose columns differ null-safely by more than the tolerance, or that one side lacks."""
    a = stored.select(*keys, *[F.col(c).alias(f"{c}__a") for c in columns], F.lit(True).alias("__a"))
    b = fresh.select(*keys, *[F.col(c).alias(f"{c}__b") for c in columns], F.lit(True).alias("__b"))
    joined = a.join(b, list(keys), "full")

    def differs(c: str) -> Column:
        x, y = F.col(f"{c}__a"), F.col(f"{c}__b")
        if stored.schema[c].dataType.typeName() in ("double", "float"):
            return ~(x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False)))
        return ~x.eqNullSafe(y)

    wrong = F.col("__a").isNull() | F.col("__b").isNull()
    for c in columns:
        wrong = wrong | differs(c)
    return joined.where(wrong).select(*keys)


def dense_grid(facts: DataFrame, cell: Sequence[str], day: str, measures: Sequence[str]) -> DataFrame:
    """Every cell on every day from the table's first to its last, with 0 where there is no fact.

    The calendar is generated per cell, so nothing is cross joined.
    """
    span = facts.agg(F.struct(F.min(day), F.max(day))).scalar()
    first, last = span.getField("col1"), span.getField("col2")
    grid = facts.select(*cell).distinct().withColumn(day, F.explode(F.sequence(first, last)))
    return grid.join(facts.select(*cell, day, *measures), [*cell, day], "left").fillna(0, list(measures))


def inner_on(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two results joined on several keys; other columns of one name are refused (ValueError)."""
    if clash := (set(a.columns) & set(b.columns)) - set(keys):
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    return a.join(b, list(keys))
