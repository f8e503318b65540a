"""Feature builders that never see the day they describe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fareline.functions.expr import ratio


def split_by_day(df: DataFrame, day: str, train: float, validation: float) -> DataFrame:
    """(day, split): the first round(n * train) distinct days, the next round(n * validation), the rest test.

    Days are ranked in one window over distinct days, a calendar's worth of rows.
    """
    days = df.select(day).where(F.col(day).isNotNull()).distinct()
    ranked = days.withColumns({"r": F.row_number().over(Window.orderBy(day)), "n": F.count(F.lit(1)).over(Window.partitionBy())})
    a, b = F.round(F.col("n") * train), F.round(F.col("n") * validation)
    return ranked.select(day, F.when(F.col("r") <= a, "train").when(F.col("r") <= a + b, "validation").otherwise("test").alias("split"))


def chronology(df: DataFrame, day: str, split: str = "split") -> DataFrame:
    """One row: whether train ends before validation begins, and that before test."""
    def bound(f, name: str):
        return f(F.when(F.col(split) == name, F.col(day)))

    return df.agg((bound(F.max, "train") < bound(F.min, "validation")).alias("train_before_validation"), (bound(F.max, "validation") < bound(F.min, "test")).alias("validation_before_test"))


def peak_share(df: DataFrame, entity: str, day: str, hour: str, kind: str, measure: str, days: int = 28, least: float = 0.08) -> DataFrame:
    """(entity, day, hour, kind, share_asof, is_peak): an hour's share of its day, averaged over the days
    of the same kind among the ``days`` before, and whether it reaches ``least``; null without history."""
    hourly = df.groupBy(entity, day, kind, hour).agg(F.sum(measure).alias("x"))
    shares = hourly.withColumn("s", ratio(F.col("x"), F.sum("x").over(Window.partitionBy(entity, day)))).withColumn("__i", F.unix_date(day))
    w = Window.partitionBy(entity, hour, kind).orderBy("__i").rangeBetween(-days, -1)
    out = shares.withColumn("share_asof", F.avg("s").over(w))
    return out.select(entity, day, hour, kind, "share_asof", (F.col("share_asof") >= least).alias("is_peak"))


def estimated_total(df: DataFrame, keys: Sequence[str], measure: str, operated: str) -> DataFrame:
    """Per key: operated, measured and their ratio, the sum, and the sum scaled up to all that operated."""
    out = df.groupBy(*keys).agg(F.count(F.when(F.col(operated), 1)).alias("operated"), F.count(F.when(F.col(operated), F.col(measure))).alias("measured"), F.sum(F.when(F.col(operated), F.col(measure))).alias("total"))
    return out.withColumns({"coverage": ratio(F.col("measured"), F.col("operated")), "estimated": F.try_divide(F.col("total").cast("double") * F.col("operated"), F.col("measured"))})
