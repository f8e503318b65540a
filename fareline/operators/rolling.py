"""Rolling totals over trailing periods by block decomposition.

The calendar of an entity is cut into blocks as long as the window. Inside a block there is a running sum
from its first day (prefix) and one to its last day (suffix); the total of the w days that end with day d is
prefix(d) plus, unless the window is exactly d's block so far, suffix(d - w + 1) of the block before.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_values(df: DataFrame, entity: str, day: str, value: str, version: str | None = None) -> DataFrame:
    """One row per entity and day: of several the value with the greatest ``version`` (of equal ones the
    greatest value). Aggregates before the shuffle, so repeated or hot days cost one row per task."""
    rows = df.where(F.col(entity).isNotNull() & (F.col(entity) != "") & F.col(day).isNotNull())
    rank = F.struct(*([F.col(version).alias("v")] if version else []), F.col(value).alias("x"))
    return rows.groupBy(F.col(entity).alias("entity"), F.col(day).alias("day")).agg(F.max(rank).getField("x").alias("value"))


def rolling_totals(df: DataFrame, entity: str, day: str, value: str, windows: Sequence[int] = (7, 30), version: str | None = None) -> DataFrame:
    """(entity, day, value, total_w, avg_w ...) for each day from an entity's first to its last.

    Days without a row are included with a null value; null values and days before the first add 0. avg_w
    divides by the days of the window that are not before the entity's first day, days without activity
    included. Rows with a null or empty entity or a null day are left out.

    A super-block, a multiple of all windows, is the unit of the shuffle, with the last max(windows) - 1 days
    of the one before repeated at its head (its halo); so an entity with a third of all rows is spread over
    as many tasks as it has super-blocks, and every window function sees at most one super-block.
    """
    reach = max(windows) - 1
    block = math.lcm(*windows) * max(1, 180 // math.lcm(*windows))
    if block > 4 * 366:
        block = max(4 * 366, reach)  # windows without a small common multiple: blocks of a window are cut at its border
    daily = daily_values(df, entity, day, value, version).withColumn("d", F.unix_date("day"))
    # a row per day of the calendar at most, whatever the share of an entity's rows was
    line = Window.partitionBy("entity").orderBy("d")
    gaps = daily.withColumns({"first": F.first("d").over(line), "next": F.lead("d").over(line)})
    days = gaps.select("entity", "first", "value", F.col("d").alias("of"), F.explode(F.sequence("d", F.coalesce(F.col("next") - 1, F.col("d")))).alias("d"))
    days = days.withColumn("value", F.when(F.col("d") == F.col("of"), F.col("value"))).drop("of")
    # the last days of a super-block are the halo of the one after, if the entity has that
    own = F.floor(F.col("d") / block)
    halo = F.when(F.pmod("d", F.lit(block)) >= block - reach, own + 1) if reach else F.lit(None)
    blocks = F.explode(F.array_compact(F.array(own, halo)))
    dense = days.select("*", blocks.alias("block")).repartition("entity", "block").withColumn("x", F.coalesce(F.col("value").cast("long"), F.lit(0).cast("long")))
    out, ordered = dense, Window.partitionBy("entity", "block").orderBy("d")
    for w in windows:
        # blocks of w days counted from the super-block's first day; the halo's are numbered below 0
        inside = Window.partitionBy("entity", "block", f"b{w}").orderBy("d")
        out = out.withColumn(f"b{w}", F.floor((F.col("d") - F.col("block") * block) / w))
        out = out.withColumn(f"p{w}", F.sum("x").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        out = out.withColumn(f"s{w}", F.sum("x").over(inside.rowsBetween(0, Window.unboundedFollowing)))
    for w in windows:
        # a window whose first day opens d's own block is that block's prefix
        same = F.lag(f"b{w}", w - 1).over(ordered) == F.col(f"b{w}")
        whole = F.lag(f"s{w}", w - 1).over(ordered)
        # fewer than w days so far: the suffix of the first day, if that is in the block before
        first_b, first_s = F.first(f"b{w}").over(ordered.rowsBetween(Window.unboundedPreceding, 0)), F.first(f"s{w}").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
        short = F.when(first_b == F.col(f"b{w}"), F.lit(0)).otherwise(first_s)
        known = F.lag("d", w - 1).over(ordered).isNotNull()
        out = out.withColumn(f"total_{w}", F.col(f"p{w}") + F.when(known, F.when(same, F.lit(0)).otherwise(whole)).otherwise(short))
        out = out.withColumn(f"avg_{w}", F.col(f"total_{w}") / F.least(F.lit(w), F.col("d") - F.col("first") + 1))
    names = [x for w in windows for x in (f"total_{w}", f"avg_{w}")]
    return out.where(F.col("d") >= F.col("block") * block).select(F.col("entity").alias(entity), F.date_from_unix_date("d").alias(day), F.col("value").alias(value), *names)
