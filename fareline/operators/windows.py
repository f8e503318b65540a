"""Window operators by column roles: entity, order and measure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareline.functions.expr import median_of, ratio


def trailing_mean(df: DataFrame, entity: Sequence[str], day: str, value: str, low: int, high: int, name: str) -> DataFrame:
    """Mean over the integer days [day + low, day + high]; with high < 0 the day itself is never seen."""
    w = Window.partitionBy(*entity).orderBy(day).rangeBetween(low, high)
    return df.withColumn(name, F.avg(value).over(w))


def growth(df: DataFrame, entity: Sequence[str], day: str, value: str, n: int, name: str) -> DataFrame:
    """mean of the last n days before the day over the n before those, less 1; null without a positive base."""
    recent = F.avg(value).over(Window.partitionBy(*entity).orderBy(day).rangeBetween(-n, -1))
    before = F.avg(value).over(Window.partitionBy(*entity).orderBy(day).rangeBetween(-2 * n, -n - 1))
    return df.withColumn(name, F.when(before > 0, recent / before - 1))


def history_median(df: DataFrame, entity: Sequence[str], day: str, value: str, low: int, high: int, name: str, least: int = 1, lower: bool = False) -> DataFrame:
    """Median of the values in a range of earlier days, and their number as <name>_n; null below ``least``.

    The frame holds at most high - low + 1 days of one entity, so the arrays are bounded.
    """
    history = F.collect_list(value).over(Window.partitionBy(*entity).orderBy(day).rangeBetween(low, high))
    out = df.withColumn("__h", history).withColumn(f"{name}_n", F.size("__h"))
    return out.withColumn(name, F.when(F.col(f"{name}_n") >= least, median_of(F.col("__h"), lower))).drop("__h")


def previous_kept(df: DataFrame, entity: Sequence[str], order: Sequence[str], value: str, keep: Column, name: str) -> DataFrame:
    """The value of the last earlier row that meets ``keep`` (the previous operated trip, say)."""
    w = Window.partitionBy(*entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(keep, F.col(value)), ignorenulls=True).over(w))


def prior_mean(df: DataFrame, entity: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Mean of all strictly earlier rows."""
    w = Window.partitionBy(*entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.avg(value).over(w))


def rolling_rows(df: DataFrame, entity: Sequence[str], order: Sequence[str], value: str, rows: int, name: str, least: int = 1) -> DataFrame:
    """Mean of the ``rows`` rows before the row; null with fewer than ``least`` values among them."""
    w = Window.partitionBy(*entity).orderBy(*order).rowsBetween(-rows, -1)
    return df.withColumn(name, F.when(F.count(value).over(w) >= least, F.avg(value).over(w)))


def relative_change(df: DataFrame, entity: Sequence[str], order: Sequence[str], value: str, rows: int, name: str) -> DataFrame:
    """The value over that of ``rows`` rows before, less 1; null without it or where it is 0."""
    return df.withColumn(name, ratio(F.col(value), F.lag(value, rows).over(Window.partitionBy(*entity).orderBy(*order))) - 1)


def lags(df: DataFrame, entity: Sequence[str], order: Sequence[str], value: str, steps: Sequence[int]) -> DataFrame:
    w = Window.partitionBy(*entity).orderBy(*order)
    return df.withColumns({f"{value}_lag_{n}": F.lag(value, n).over(w) for n in steps})


def running_total(df: DataFrame, entity: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    w = Window.partitionBy(*entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))


def overlaps_earlier(df: DataFrame, entity: Sequence[str], start: str, end: str, name: str) -> DataFrame:
    """Whether an interval starts before the end of any earlier one of its group (nested ones included)."""
    w = Window.partitionBy(*entity).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.col(start) < F.max(end).over(w), F.lit(False)))


def share_of_total(df: DataFrame, within: Sequence[str], value: str, name: str) -> DataFrame:
    return df.withColumn(name, ratio(F.col(value), F.sum(value).over(Window.partitionBy(*within))))


def zscore(df: DataFrame, within: Sequence[str], value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*within)
    return df.withColumn(name, F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev(value).over(w)))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= k).drop("__rank")


def sessions(df: DataFrame, entity: Sequence[str], at: str, order: Sequence[str], gap_seconds: int) -> DataFrame:
    """Adds session, counting from 1, with a new one after a pause of more than gap_seconds."""
    w = Window.partitionBy(*entity).orderBy(at, *order)
    pause = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))
    new = F.coalesce(pause > gap_seconds * 1_000_000, F.lit(True)).cast("int")
    return df.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
