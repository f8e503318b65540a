"""Aggregate operators by column roles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareline.functions.expr import ratio


def exact_percentile(value: str, p: float) -> Column:
    """The discrete quantile, not interpolated. A group's distinct values are held in one task; for groups without
    a bound see ``ranks.exact_quantiles``."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def most_frequent(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """The most frequent non-null value per key; of equally frequent ones the least."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return n.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(name), F.max("__n").alias(f"{name}_n"))


def pivot_means(df: DataFrame, keys: Sequence[str], column: str, labels: Sequence[str], value: str) -> DataFrame:
    """One column of means per label, in one aggregate; null where the label does not occur."""
    return df.groupBy(*keys).agg(*[F.avg(F.when(F.col(column) == x, F.col(value))).alias(x) for x in labels])


def by_dimensions(df: DataFrame, dimensions: dict[str, Column], aggregates: Sequence[Column]) -> DataFrame:
    """(dimension, value, aggregates): one scan for all dimensions, each row unpivoted once per dimension."""
    pairs = F.array(*[F.struct(F.lit(name).alias("dimension"), c.cast("string").alias("value")) for name, c in dimensions.items()])
    long = df.withColumn("__d", F.explode(pairs)).select("*", "__d.dimension", "__d.value")
    return long.where("value is not null").groupBy("dimension", "value").agg(*aggregates)


def factor_with_fallback(cells: DataFrame, levels: Sequence[Sequence[str]], top: str, bottom: str, least: float, names: Sequence[str]) -> DataFrame:
    """top / bottom of the finest level whose bottom reaches ``least``, else of the coarsest.

    levels: key lists from fine to coarse, the first being the cells' own keys, [] being all cells. Adds factor
    and factor_level. The coarser sums are aggregated from the cells, not from the rows under them.
    """
    out = cells
    for i, keys in enumerate(levels[1:], 1):
        if not keys:
            total = cells.agg(F.struct(F.sum(top).alias("t"), F.sum(bottom).alias("b"))).scalar()
            out = out.withColumns({f"__t{i}": total.getField("t"), f"__b{i}": total.getField("b")})
            continue
        sums = cells.groupBy(*keys).agg(F.sum(top).alias(f"__t{i}"), F.sum(bottom).alias(f"__b{i}"))
        out = out.join(sums, list(keys))
    picks = [(F.col(bottom), F.col(top))] + [(F.col(f"__b{i}"), F.col(f"__t{i}")) for i in range(1, len(levels))]
    factor, level = ratio(picks[-1][1], picks[-1][0]), F.lit(names[-1])
    for (b, t), name in list(zip(picks, names))[-2::-1]:
        factor, level = F.when(b >= least, ratio(t, b)).otherwise(factor), F.when(b >= least, name).otherwise(level)
    return out.withColumns({"factor": factor, "factor_level": level}).select(*cells.columns, "factor", "factor_level")


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, copies, versions) of the keys that occur more than once; versions > 1: the copies differ."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.countDistinct(F.xxhash64(*df.columns)).alias("versions")).where("copies > 1")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (n, fingerprint) that does not depend on the order of rows or files."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("fingerprint"))


def multiset_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows in a, in b and in both, copies counted."""
    n = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_a")).join(b.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_b")), list(keys), "full").fillna(0, ["n_a", "n_b"])
    return n.agg(F.coalesce(F.sum("n_a"), F.lit(0)).alias("n_a"), F.coalesce(F.sum("n_b"), F.lit(0)).alias("n_b"), F.coalesce(F.sum(F.least("n_a", "n_b")), F.lit(0)).alias("n_both"))


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(class, support, precision, recall, f1) per class that occurs as label or prediction."""
    cells = df.groupBy(F.col(label).cast("string").alias("l"), F.col(predicted).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    parts = F.array(F.struct(F.col("l").alias("class"), F.col("n").alias("a"), F.lit(0).alias("b"), F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("h")), F.struct(F.col("p").alias("class"), F.lit(0).alias("a"), F.col("n").alias("b"), F.lit(0).alias("h")))
    c = cells.select(F.inline(parts)).groupBy("class").agg(F.sum("a").alias("support"), F.sum("b").alias("found"), F.sum("h").alias("hits"))
    return c.select("class", "support", ratio(F.col("hits"), F.col("found")).alias("precision"), ratio(F.col("hits"), F.col("support")).alias("recall"), ratio(2 * F.col("hits"), F.col("support") + F.col("found")).alias("f1"))


def regression_report(df: DataFrame, label: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, mae, rmse, r2 and mape (rows with label 0 left out of mape) over rows with both values."""
    x, p = F.col(label).cast("double"), F.col(predicted).cast("double")
    rows = df.where(x.isNotNull() & p.isNotNull())
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(x - p)).alias("mae"), F.sqrt(F.avg((x - p) * (x - p))).alias("rmse"), (1 - F.try_divide(F.sum((x - p) * (x - p)), F.var_pop(x) * F.count(F.lit(1)))).alias("r2"), F.avg(F.when(x != 0, F.abs((x - p) / x))).alias("mape"))


def column_profile(df: DataFrame, columns: Sequence[str], top: int = 5) -> DataFrame:
    """(column, rows, nulls, distinct_values, min, max, mean, std, q25, q50, q75, top_values) per column.

    Columns are unpivoted in one scan and counted per value first, so a hot value costs one row per task.
    Numbers have moments; top_values lists value:count of the most frequent, ties by value.
    """
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte")}
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("x")) for c in columns])
    counts = df.select(F.inline(parts)).groupBy("column", "value", "x").agg(F.count(F.lit(1)).alias("n"))
    n, x = F.col("n"), F.col("x")
    mean = F.try_divide(F.sum(n * x), F.sum(F.when(x.isNotNull(), n)))
    m = counts.groupBy("column").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), n)), F.lit(0)).alias("nulls"), F.count("value").alias("distinct_values"),
        F.when(F.count(x) > 0, F.min(x).cast("string")).otherwise(F.min("value")).alias("min"), F.when(F.count(x) > 0, F.max(x).cast("string")).otherwise(F.max("value")).alias("max"),
        mean.alias("mean"), F.sum(n * x).alias("__s"), F.sum(n * x * x).alias("__q"), F.sum(F.when(x.isNotNull(), n)).alias("__n"),
        *[F.percentile(x, p, n).alias(f"q{int(p * 100)}") for p in (0.25, 0.5, 0.75)],
    )
    from pyspark.sql import Window

    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    best = counts.where("value is not null").withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    tops = best.groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "value", "n"))), lambda s: F.concat(s["value"], F.lit(":"), s["n"].cast("string"))), ", ").alias("top_values"))
    std = F.when(F.col("__n") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("__q") - F.col("__s") * F.col("__s") / F.col("__n")) / (F.col("__n") - 1))))
    return m.join(tops, "column", "left").select("column", "rows", "nulls", "distinct_values", "min", "max", "mean", std.alias("std"), "q25", "q50", "q75", "top_values")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) of the pairs of values that occur; rows with a null are left out."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two labellings of the same rows, from their contingency table; null
    where chance leaves nothing to explain."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("__a"), F.col(b).alias("__b")).agg(F.count(F.lit(1)).cast("double").alias("__n"))

    def pairs(x: Column) -> Column:
        return x * (x - 1) / 2

    def within(key: str) -> Column:
        return cells.groupBy(key).agg(F.sum("__n").alias("__x")).agg(F.sum(pairs(F.col("__x")))).scalar()

    one = cells.agg(F.sum(pairs(F.col("__n"))).alias("cells"), pairs(F.sum("__n")).alias("all"))
    one = one.withColumns({"rows": within("__a"), "cols": within("__b")})
    chance = F.try_divide(F.col("rows") * F.col("cols"), F.col("all"))
    return one.select(F.try_divide(F.col("cells") - chance, (F.col("rows") + F.col("cols")) / 2 - chance).alias("adjusted_rand"))


def classification_scores(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: accuracy, macro_f1 (mean over classes) and weighted_f1 (by support)."""
    hits = df.agg(F.avg((F.col(label).cast("string") == F.col(predicted).cast("string")).cast("double"))).scalar()
    r = classification_report(df, label, predicted)
    return r.agg(F.avg("f1").alias("macro_f1"), ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1")).select(hits.alias("accuracy"), "macro_f1", "weighted_f1")


def band_accuracy(df: DataFrame, label: str, predicted: str, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """One row: the share of predictions within each band (absolute, relative to the label) and n; a prediction
    is within if either bound allows it. Rows without both values are left out."""
    x, p = F.col(label), F.col(predicted)
    off = F.abs(p - x)
    rows = df.where(x.isNotNull() & p.isNotNull())
    return rows.agg(*[F.avg(((off <= most) if not part else (off <= part * x) if not most else ((off <= most) | (off <= part * x))).cast("double")).alias(name) for name, (most, part) in bands.items()], F.count(F.lit(1)).alias("n"))


def store_parity(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(column, distinct_a, distinct_b, sum_a, sum_b, same) for the columns of two stores of one table.

    Numbers are compared by their sums and distinct values, other columns by distinct values.
    """
    numbers = {f.name for f in a.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte", "decimal")}

    def measures(df: DataFrame) -> Column:
        return df.agg(F.array(*[F.struct(F.countDistinct(c).alias("d"), (F.sum(c).cast("double") if c in numbers else F.lit(None).cast("double")).alias("s")) for c in a.columns])).scalar()

    one = a.sparkSession.range(1).select(F.arrays_zip(F.array(*map(F.lit, a.columns)).alias("c"), measures(a).alias("a"), measures(b).alias("b")).alias("z"))
    m = one.select(F.explode("z").alias("z")).select(F.col("z.c").alias("column"), F.col("z.a.d").alias("distinct_a"), F.col("z.b.d").alias("distinct_b"), F.col("z.a.s").alias("sum_a"), F.col("z.b.s").alias("sum_b"))
    close = F.col("sum_a").eqNullSafe(F.col("sum_b")) | F.coalesce(F.abs(F.col("sum_a") - F.col("sum_b")) <= tolerance * F.greatest(F.abs("sum_a"), F.lit(1.0)), F.lit(False))
    return m.withColumn("same", (F.col("distinct_a") == F.col("distinct_b")) & close)


def flat_metrics(df: DataFrame, group: str, metrics: Sequence[str]) -> DataFrame:
    """(group, metric, value): a row per metric that a group has."""
    values = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*[F.col(m).cast("double") for m in metrics])), lambda k, v: v.isNotNull())
    return df.select(group, F.explode(values).alias("metric", "value"))
