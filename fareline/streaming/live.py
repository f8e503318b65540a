"""Structured Streaming forms of the event operators; each also runs on a batch frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 4, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def latest_positions(events: DataFrame, entity: str, at: str, columns: list[str], window: str = "3 minutes", late: str = "10 minutes", tie: Sequence[str] = ()) -> DataFrame:
    """The last event of each entity per window; events later than ``late`` are dropped by the watermark.

    Of several at the last instant the one with the greatest ``tie`` columns counts (null is least); without
    them, or where they agree as well, any one.
    """
    marked = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return marked.groupBy(F.window(at, window), entity).agg(F.max_by(F.struct(at, *columns), F.struct(at, *tie)).alias("r")).select(entity, F.col("window.start").alias("window_start"), "r.*")


def tumbling_counts(events: DataFrame, at: str, keys: list[str], window: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    marked = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    w = F.window(at, window, slide) if slide else F.window(at, window)
    return marked.groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def without_repeats(events: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """One event per key within the watermark, wherever its copies arrive."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, entity: str, at: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    marked = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return marked.groupBy(F.session_window(at, gap), entity).agg(F.count(F.lit(1)).alias("n")).select(entity, F.col("session_window.start").alias("start"), "n")


def split_late(events: DataFrame, at: str, day: str, low_days: int, high_days: int) -> tuple[DataFrame, DataFrame]:
    """(in time, out of window): the event's day lies in [day + low_days, day + high_days) or not."""
    d = F.datediff(F.col(at).cast("date"), F.col(day))
    inside = F.coalesce((d >= low_days) & (d < high_days), F.lit(False))
    return events.where(inside), events.where(~inside)


def same_weekday(now: Column, last: Column) -> Column:
    """The last day up to ``last`` that is of the weekday of ``now``."""
    return F.date_sub(last, F.pmod(F.dayofweek(last) - F.dayofweek(now), F.lit(7)))


def run_to_memory(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is available, into an in-memory table: for tests and small looks."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
