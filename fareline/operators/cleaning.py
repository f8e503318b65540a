"""Cleaning: duplicates, corrections, statuses, an audit log and a balance of rows.

Rules mark rows through their violations; a marked row is corrected where its correction gives a value,
else flagged or quarantined. rows in = clean + removed + quarantined.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareline.functions.expr import minutes_between
from fareline.operators.joins import unambiguous_lookup
from fareline.operators.quality import Catalog, Rule, Violations

Frames = tuple[DataFrame, Column]


@dataclass(frozen=True)
class Correction:
    """``apply`` adds columns to a table and gives the new value of ``column`` (null: cannot be corrected)."""

    column: str
    apply: Callable[[DataFrame], Frames]


def from_lookup(column: str, key: str, other: DataFrame, value: str) -> Correction:
    """The value that another table gives for the key, if it gives only one."""

    def apply(df: DataFrame) -> Frames:
        facts = unambiguous_lookup(other.select(F.col(key).alias(f"__lk_{column}"), F.col(value).alias(f"__lv_{column}")), f"__lk_{column}", f"__lv_{column}")
        return df.join(facts, df[key] == facts[f"__lk_{column}"], "left").drop(f"__lk_{column}"), F.col(f"__lv_{column}")

    return Correction(column, apply)


def from_minutes(column: str, start: str, end: str, low: float, high: float) -> Correction:
    """Minutes between two times, if plausible."""

    def apply(df: DataFrame) -> Frames:
        m = F.round(minutes_between(F.col(start), F.col(end)), 1)
        return df, F.when(m.between(low, high), m)

    return Correction(column, apply)


def from_children(column: str, key: str, children: DataFrame, value: str) -> Correction:
    """The greatest value among the child records."""

    def apply(df: DataFrame) -> Frames:
        most = children.groupBy(F.col(key).alias(f"__ck_{column}")).agg(F.max(value).alias(f"__cv_{column}"))
        return df.join(most, df[key] == most[f"__ck_{column}"], "left").drop(f"__ck_{column}"), F.col(f"__cv_{column}")

    return Correction(column, apply)


def resequenced(column: str, group_by: Sequence[str], order: Sequence[str]) -> Correction:
    """1..n by another order."""
    return Correction(column, lambda df: (df, F.row_number().over(Window.partitionBy(*group_by).orderBy(*order))))


def swapped(lat: str, lon: str, box: Sequence[float]) -> tuple[Correction, Correction]:
    """Corrections of two coordinates: each takes the other's value, if both then lie in the box (south, north,
    west, east)."""
    fits = F.col(lon).between(box[0], box[1]) & F.col(lat).between(box[2], box[3])
    return Correction(lat, lambda df: (df, F.when(fits, F.col(lon)))), Correction(lon, lambda df: (df, F.when(fits, F.col(lat))))


def split_duplicates(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, removed, conflicting): identical copies leave one row, keys with differing copies go whole.

    ``removed`` has a row (keys, copies) per key. Copies are aggregated before the shuffle.
    """
    w = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__copies"))
    versions = w.groupBy(*keys).agg(F.count(F.lit(1)).alias("__versions")).where("__versions > 1").drop("__versions")
    conflicting = df.join(versions, list(keys), "left_semi")
    single = w.join(versions, list(keys), "left_anti")
    removed = single.where("__copies > 1").select(*keys, (F.col("__copies") - 1).alias("copies"))
    return single.drop("__copies"), removed, conflicting


def clean(c: Catalog, table: str, rules: Sequence[Rule], violations: Violations, corrections: dict[str, Correction]) -> DataFrame:
    """The table with dq_flags, dq_corrected, dq_quarantine (rule ids, sorted) and dq_status.

    status: quarantined, flagged, corrected or clean, whichever comes first. A rule with action 'correct'
    whose correction gives no value falls back to a flag.
    """
    mine = [r for r in rules if r.table == table]
    hits = violations.where(F.col("table") == table).groupBy(F.col("record_key").alias("__key")).agg(F.collect_set("rule_id").alias("__hits"))
    df = c.tables[table].withColumn("__key", c.key(table)).join(hits, "__key", "left").withColumn("__hits", F.coalesce("__hits", F.expr("cast(array() as array<string>)")))
    columns, marks = c.tables[table].columns, {"flag": [], "correct": [], "quarantine": []}
    for r in mine:
        hit = F.array_contains("__hits", r.rule_id)
        if r.action == "correct" and r.rule_id in corrections:
            fix = corrections[r.rule_id]
            df, value = fix.apply(df)
            df = df.withColumn(f"__fix_{r.rule_id}", F.when(hit, value))
            fixed = F.col(f"__fix_{r.rule_id}").isNotNull()
            marks["correct"].append(F.when(fixed, r.rule_id))
            marks["flag"].append(F.when(hit & ~fixed, r.rule_id))
        else:
            marks["quarantine" if r.action == "quarantine" else "flag"].append(F.when(hit, r.rule_id))
    empty = F.expr("cast(array() as array<string>)")
    lists = {k: F.array_sort(F.array_compact(F.array(*v))) if v else empty for k, v in marks.items()}
    df = df.withColumns({"dq_flags": lists["flag"], "dq_corrected": lists["correct"], "dq_quarantine": lists["quarantine"]})
    status = F.when(F.size("dq_quarantine") > 0, "quarantined").when(F.size("dq_flags") > 0, "flagged").when(F.size("dq_corrected") > 0, "corrected").otherwise("clean")
    new = {}
    for r in mine:
        if r.action == "correct" and r.rule_id in corrections:
            column = corrections[r.rule_id].column
            new[column] = F.coalesce(F.col(f"__fix_{r.rule_id}"), new.get(column, F.col(column)))
    return df.withColumn("dq_status", status).select("__key", *[new.get(x, F.col(x)).cast(c.tables[table].schema[x].dataType).alias(x) for x in columns], "dq_flags", "dq_corrected", "dq_quarantine", "dq_status", F.struct(*[F.col(x) for x in columns]).alias("__original")).withColumnRenamed("__key", "record_key")


def audit_log(cleaned: DataFrame, table: str, rules: Sequence[Rule], corrections: dict[str, Correction]) -> DataFrame:
    """A row per record and rule that marked it: original and corrected value, action, final status."""
    parts = []
    for r in [r for r in rules if r.table == table]:
        fixed = F.array_contains("dq_corrected", r.rule_id)
        hit = fixed | F.array_contains("dq_flags", r.rule_id) | F.array_contains("dq_quarantine", r.rule_id)
        column = corrections[r.rule_id].column if r.rule_id in corrections else None
        was = F.col(f"__original.{column}").cast("string") if column else F.lit(None).cast("string")
        now = F.when(fixed, F.col(column).cast("string")) if column else F.lit(None).cast("string")
        parts.append(cleaned.where(hit).select(F.lit(table).alias("table"), "record_key", F.lit(r.rule_id).alias("rule_id"), F.lit(column).cast("string").alias("column"), was.alias("original_value"), now.alias("corrected_value"), F.when(fixed, "correct").when(F.array_contains("dq_quarantine", r.rule_id), "quarantine").otherwise("flag").alias("action"), F.col("dq_status").alias("final_status")))
    return reduce(DataFrame.unionByName, parts)


def reconcile(rows_in: DataFrame, clean_rows: DataFrame, removed: DataFrame, quarantined: DataFrame) -> DataFrame:
    """One row of counts, and whether they balance; ``removed`` has a column copies."""
    def count(df: DataFrame, of: Column) -> Column:
        return df.agg(F.coalesce(of, F.lit(0)).cast("long")).scalar()

    one = rows_in.agg(F.count(F.lit(1)).alias("rows_in"))
    out = one.select("rows_in", count(clean_rows, F.count(F.lit(1))).alias("clean"), count(removed, F.sum("copies")).alias("removed"), count(quarantined, F.count(F.lit(1))).alias("quarantined"))
    return out.withColumn("balanced", F.col("rows_in") == F.col("clean") + F.col("removed") + F.col("quarantined"))
