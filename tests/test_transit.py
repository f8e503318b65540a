"""Statements on trips made for the purpose."""

import random
from types import SimpleNamespace

from pyspark.sql import functions as F

from fareline.plans.transit import an_underutilized

TRIPS = "route_id string, direction int, day_class string, period string, distance_km double, service_date date, ran boolean, max_load int, capacity int, boardings int, band string, peak boolean, arrival_s bigint"


def underutilized(trips):
    return an_underutilized(SimpleNamespace(trips=trips.withColumn("occupancy", F.try_divide(F.col("max_load").cast("double"), F.col("capacity").cast("double")))))


def test_means_on_the_border_of_two_roundings_do_not_hang_on_the_order_of_rows(spark):
    loads = [58, 70, 62, 67, 58, 59, 73, 65, 71, 61, 52, 60, 60, 69, 66, 64]  # of 58 places: 1.09375 in the mean
    rows = []
    for seed in range(200):
        random.Random(seed).shuffle(loads)
        rows += [(f"R{seed}", 1, "weekday", "pm_peak", 10.0, None, True, x, 58, 20, "over", False, 0) for x in loads]
    found = underutilized(spark.createDataFrame(rows, TRIPS).coalesce(1))
    assert {r.occupancy for r in found.select("occupancy").collect()} == {1.0938}


def test_rows_without_a_load_or_a_capacity_count_on_neither_side(spark):
    rows = [("R", 1, "weekday", "midday", 10.0, None, True, load, size, 20, None, False, 0) for load, size in ((1, 3), (1, 3), (None, 3), (1, None), (1, 0))]
    (r,) = underutilized(spark.createDataFrame(rows, TRIPS)).collect()
    assert (r.measured, r.occupancy) == (2, 0.3333)


def test_middle_of_more_cells_than_a_sketch_tells_apart(spark):
    n = 60_001
    i = F.col("id").cast("int")
    cells = spark.range(n).select(
        F.concat(F.lit("R"), "id").alias("route_id"), F.lit(1).alias("direction"), F.lit("weekday").alias("day_class"), F.lit("midday").alias("period"), F.lit(1.0).alias("distance_km"), F.lit(None).cast("date").alias("service_date"),
        F.lit(True).alias("ran"), F.lit(1).alias("max_load"), F.lit(10).alias("capacity"), (i * 7919 % n).alias("boardings"), F.lit("low").alias("band"), F.lit(False).alias("peak"), F.lit(0).cast("bigint").alias("arrival_s"),
    )
    assert underutilized(cells).select("middle").distinct().collect() == [((n - 1) / 2,)]
