"""Ranks and quantiles over whole tables, spread over range partitions instead of one task.

Rows are cut into ranges of their order, which are stored; what lies before a range is one row per range and
group, so a group of any size is ranked in as many tasks as it has ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareline.session import stored


def running_sums(df: DataFrame, group: Sequence[str], order: Sequence[Column], weight: str, name: str) -> DataFrame:
    """Adds the sum of ``weight`` over the rows of the group up to the row, in the order given (rows that are equal
    in it come in any order). ``group`` may be empty. Null weights add nothing."""
    ranges = stored(df.repartitionByRange(*group, *order).withColumn("__range", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range and group
    sums = ranges.groupBy("__range", *group).agg(F.sum(weight).alias("__sum")).withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    keyed = sums.select(F.col("__range").alias("__of"), *[F.col(g).alias(f"__of_{g}") for g in group], "__before")
    same = F.col("__range") == F.col("__of")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__of_{g}"))
    inside = Window.partitionBy("__range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranges.join(keyed, same).withColumn(name, F.col("__before") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return out.drop("__range", "__of", "__before", *[f"__of_{g}" for g in group])


def dense_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the dense rank (1 for the greatest; nulls last) of ``value`` over all rows."""
    values = df.select(value).distinct().withColumn("__one", F.lit(1))
    ranked = running_sums(values, [], [F.desc_nulls_last(value)], "__one", name).select(F.col(value).alias("__value"), F.col(name).cast("int").alias(name))
    return df.join(ranked, df[value].eqNullSafe(ranked["__value"])).drop("__value")


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(group, q0, q1 ...): the discrete quantiles of the non-null values, the least with at least the share of
    the rows at or below it. Equal values are counted before the shuffle."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("__n"))
    upto = running_sums(counts, group, [F.asc(value)], "__n", "__upto")
    totals = counts.groupBy(*group).agg(F.sum("__n").alias("__total"))
    if group:
        named = totals.withColumnsRenamed({g: f"__t_{g}" for g in group})
        placed = upto.join(named, [F.col(g).eqNullSafe(F.col(f"__t_{g}")) for g in group])
    else:
        placed = upto.withColumn("__total", counts.agg(F.sum("__n")).scalar())
    picks = []
    for i, p in enumerate(shares):
        wanted = F.greatest(F.ceil(F.col("__total") * F.lit(p)), F.lit(1))
        picks.append(F.min(F.when(F.col("__upto") >= wanted, F.col(value))).alias(f"q{i}"))
    return placed.groupBy(*group).agg(*picks)
