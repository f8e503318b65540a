"""Queries p1_ to p6_: the training-data problems on tables, over the whole tables named in each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fareline.operators.asof import state_asof_join
from fareline.operators.intervals import continuous_periods
from fareline.operators.orphans import orphan_references, parents_of
from fareline.operators.rolling import rolling_totals
from fareline.operators.skew import hot_keys, hot_keys_of, skew_join
from fareline.operators.spikes import implausible_readings
from fareline.plans.problem_sql import SQL as TWINS
from fareline.plans.problem_sql import typed_sql
from fareline.session import checkpoint, table
from fareline.sources.recovery import Contract, is_decimal, is_int32, is_moment, parse_lines, split_failed, typed

SEP = "\x1f"
#: Events of one key in a task; a key with more is split.
MAX_ROWS = 250_000


def text_key(*columns: str) -> Column:
    """Several columns as one text; null is a value of its own."""
    return F.concat_ws(SEP, *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


# ---- 1: attributes as known at event time


def trips_as_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of trips with the schedule and vehicle version in force and known at its departure.

    schedule_in_force, version_in_force and capacity_total are null where nothing was in force;
    schedule_known and vehicle_known tell whether the references exist at all. row_hash is of the whole row:
    copies of a row come out as often as they go in, and equal in every column.
    """
    columns = ["trip_id", "schedule_id", "vehicle_id", "service_date", "scheduled_departure"]
    raw = table(spark, sf_dir, "trips")
    trips = raw.select(*columns, F.xxhash64(*raw.columns).alias("row_hash"))
    schedules = table(spark, sf_dir, "schedules").select("schedule_id", "route_id", "service_id", "direction", "period", "valid_from", "valid_to").distinct()
    schedules = schedules.withColumn("line", text_key("route_id", "service_id", "direction", "period"))
    named = schedules.where("schedule_id is not null and schedule_id != ''").groupBy("schedule_id").agg(F.min("line").alias("line"))
    joined = skew_join(trips, named, "schedule_id", "left", spread=F.xxhash64("trip_id"), hot=hot_keys(raw, "schedule_id", MAX_ROWS))
    # effective_from <= service_date and recorded_at <= scheduled_departure on one axis: effective_from is
    # moved by the days from service_date to the departure's date, once for each such distance of a vehicle
    lag = F.datediff(F.col("scheduled_departure").cast("date"), "service_date")
    named_vehicle = F.col("vehicle_id").isNotNull() & (F.col("vehicle_id") != "")
    events = joined.withColumn("lag", F.coalesce(lag, F.lit(0))).withColumns({"day": F.unix_date("service_date").cast("long"), "carrier": F.when(named_vehicle, text_key("vehicle_id", "lag")), "moment": F.when(lag.isNotNull(), micros("scheduled_departure"))})
    events = checkpoint(events)  # read for the counts, the distances and the join
    by_line, by_carrier = hot_keys_of(events, ["line", "carrier"], MAX_ROWS)
    versions = schedules.select("line", F.col("schedule_id").alias("schedule_in_force"), "valid_from", F.unix_date("valid_from").cast("long").alias("start"), F.when(F.col("valid_to").isNotNull(), F.unix_date("valid_to").cast("long") + 1).alias("end"))
    scheduled = state_asof_join(events, versions, "line", "day", "start", ["valid_from", "schedule_in_force"], ["schedule_in_force"], end="end", max_rows=MAX_ROWS, hot=by_line, most_versions=table(spark, sf_dir, "schedules").count())
    vehicles = table(spark, sf_dir, "vehicles").select("vehicle_id", "version_id", "capacity_total", "effective_from", "recorded_at").distinct()
    order = ["effective_from", "recorded_at", "version_id"]
    last = vehicles.groupBy("vehicle_id").agg(F.max_by("version_id", F.struct(*order)).alias("last_version"))
    lags = events.where("carrier is not null").select("vehicle_id", "lag").distinct()
    states = vehicles.join(last, "vehicle_id").join(lags, "vehicle_id")
    available = F.greatest(micros("recorded_at"), F.unix_micros(F.date_add("effective_from", F.col("lag")).cast("timestamp")))
    states = states.where("effective_from is not null and recorded_at is not null").select(text_key("vehicle_id", "lag").alias("carrier"), available.alias("start"), *order, F.col("version_id").alias("version_in_force"), "capacity_total", "last_version")
    out = state_asof_join(scheduled, states, "carrier", "moment", "start", order, ["version_in_force", "capacity_total", "last_version"], known="vehicle_known", max_rows=MAX_ROWS, hot=by_carrier, most_versions=table(spark, sf_dir, "vehicles").count())  # of a carrier's key
    return out.select(*columns, "row_hash", "schedule_in_force", "version_in_force", "capacity_total", "last_version", F.col("line").isNotNull().alias("schedule_known"), "vehicle_known")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trips_as_known(spark, sf_dir).where("schedule_known and vehicle_known")
    other = ~F.col("schedule_in_force").eqNullSafe(F.col("schedule_id")) | F.col("version_in_force").isNull() | (F.col("version_in_force") != F.col("last_version"))
    cases = t.where(other).select("row_hash", "trip_id", F.coalesce("schedule_in_force", F.lit("")).alias("schedule_id"), F.coalesce("version_in_force", F.lit(0)).alias("version_id"))
    return cases.distinct().drop("row_hash")  # copies are dropped where there are few rows


def p1_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips_as_known(spark, sf_dir).select("row_hash", "trip_id", "service_date", "scheduled_departure", "schedule_in_force", "version_in_force", "capacity_total").distinct().drop("row_hash")


# ---- 2: rows that fail to parse

CONTRACTS = {
    "delays": Contract(
        ("delay_id", "trip_id", "route_id", "stop_id", "service_date", "scheduled_arrival", "actual_arrival", "scheduled_departure", "actual_departure", "delay_minutes", "delay_reason", "record_source"),
        r'"?D[0-9]+"?,', {"delay_minutes": is_decimal},
    ),
    "tickets": Contract(
        ("ticket_id", "passenger_id", "trip_id", "route_id", "service_date", "entry_stop_id", "exit_stop_id", "entry_time", "exit_time", "ticket_type", "fare_category", "fare_amount", "payment_method"),
        r'"?K[0-9]+"?,', {"entry_time": is_moment},
    ),
    "passenger_counts": Contract(
        ("count_id", "trip_id", "route_id", "service_date", "vehicle_id", "boardings", "alightings", "max_load", "max_load_stop_id", "denied_boardings", "card_taps"),
        r'"?C[0-9]+"?,', {"boardings": is_int32},
    ),
}

TYPES = {
    "delays": ["string"] * 4 + ["date"] + ["timestamp_ntz"] * 4 + ["double", "string", "string"],
    "tickets": ["string"] * 4 + ["date", "string", "string", "timestamp_ntz", "timestamp_ntz", "string", "string", "double", "string"],
    "passenger_counts": ["string"] * 3 + ["date", "string", "int", "int", "int", "string", "int", "int"],
}


def parsed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(table(spark, sf_dir, "raw_records"), CONTRACTS, "record_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # copies of a line are dropped here, where there are few rows
    return split_failed(parsed_records(spark, sf_dir)).select("record_id", "reason").distinct()


def p2_typed(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return typed(parsed_records(spark, sf_dir), CONTRACTS[name], name, "record_id", TYPES[name]).distinct()

    return query


def p2_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_failed(parsed_records(spark, sf_dir)).select("record_id", "table_name", "reason").distinct().groupBy("table_name", "reason").agg(F.count(F.lit(1)).alias("n"))


# ---- 3: rolling totals


def boardings_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_totals(table(spark, sf_dir, "route_daily_boardings"), "route_id", "service_date", "boardings", (7, 30), "loaded_at")


def p3_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boardings_rolling(spark, sf_dir).select("route_id", "service_date", "boardings", "total_7", "total_30", F.round("avg_7", 6).alias("avg_7"), F.round("avg_30", 6).alias("avg_30"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boardings_rolling(spark, sf_dir).where("boardings is null").select("route_id", F.date_format("service_date", "yyyy-MM-dd").alias("service_date"), "total_7", "total_30")


# ---- 4: references to records that do not exist


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tombstones = table(spark, sf_dir, "tombstones")

    def deleted(name: str) -> DataFrame:
        return tombstones.where(F.col("table_name") == name).select(F.col("record_key").alias("key"), "deleted_at")

    parents = {
        "trips": parents_of(table(spark, sf_dir, "trips"), "trip_id", "received_at", deleted("trips")),
        "stops": parents_of(table(spark, sf_dir, "stops"), "stop_id", None, deleted("stops")),
        "vehicles": parents_of(table(spark, sf_dir, "vehicles"), "vehicle_id", "recorded_at", deleted("vehicles")),
    }
    fields = (
        ("tickets", "ticket_id", "service_date", "received_at", {"trip_id": "trips", "entry_stop_id": "stops"}),
        ("passenger_counts", "count_id", "service_date", "received_at", {"vehicle_id": "vehicles"}),
        ("routes", "route_id", "launch_date", None, {"origin_stop_id": "stops"}),
    )
    refs = None
    for child, record, day, at, of in fields:
        when = F.col(at) if at else F.lit(None).cast("timestamp_ntz")
        each = F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.lit(parent).alias("parent"), F.col(f).alias("key")) for f, parent in of.items()]))
        rows = table(spark, sf_dir, child).select(F.lit(child).alias("table_name"), F.col(record).alias("record_key"), F.col(day).alias("day"), when.alias("at"), each)
        refs = rows if refs is None else refs.unionByName(rows)
    # copies of a record name the same reference: one row
    period = F.date_format("day", "yyyy-MM").alias("period")
    return orphan_references(refs, parents).select("table_name", "field_name", "record_key", period, "reason").distinct()


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_found(spark, sf_dir).groupBy("table_name", "field_name", "period", "reason").agg(F.count(F.lit(1)).alias("n"))


# ---- 5: overlapping and gapped intervals


def minute_of_day(column: str) -> Column:
    parts = F.split(column, ":")
    hour, minute = F.get(parts, F.lit(0)).try_cast("long"), F.get(parts, F.lit(1)).try_cast("long")
    return F.when((hour.between(0, 24)) & minute.between(0, 59), hour * 60 + minute)


def schedule_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods on both axes; a row without valid_from is left out, one without usable times on the clock only."""
    s = table(spark, sf_dir, "schedules").where("route_id is not null and route_id != '' and valid_from is not null")
    days = s.select(F.concat_ws(SEP, F.lit("days"), text_key("route_id", "service_id", "direction", "period")).alias("entity"), F.col("schedule_id").alias("source"), F.unix_date("valid_from").cast("long").alias("lo"), (F.unix_date("valid_to").cast("long") + 1).alias("hi"))
    start, end = minute_of_day("start_time"), minute_of_day("end_time")
    clock = s.where(start.isNotNull() & end.isNotNull()).select(F.concat_ws(SEP, F.lit("clock"), text_key("route_id", "service_id", "direction", "valid_from")).alias("entity"), F.col("schedule_id").alias("source"), start.alias("lo"), F.when(end > start, end).otherwise(end + 1440).alias("hi"))
    return continuous_periods(days.unionByName(clock))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = schedule_periods(spark, sf_dir).withColumn("k", F.split("entity", SEP))
    merged = F.when(F.col("shared"), F.struct(F.lit("merged").alias("kind"), F.col("lo").alias("a"), F.col("hi").alias("b")))
    gap = F.when(F.col("next_lo").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.col("hi").alias("a"), F.col("next_lo").alias("b")))
    found = p.select("k", F.inline(F.array_compact(F.array(merged, gap))))
    axis = F.col("k")[0]

    def day(x: Column) -> Column:
        return F.date_format(F.date_from_unix_date(x.cast("int")), "yyyy-MM-dd")

    def clock(x: Column) -> Column:
        return F.format_string("%02d:%02d", F.floor(x % 1440 / 60), x % 60)

    def null(i: int) -> Column:
        return F.nullif(F.col("k")[i], F.lit("\x00"))

    by_day = axis == "days"
    to = F.when(by_day, F.coalesce(day(F.col("b") - 1), F.lit(""))).otherwise(clock(F.col("b")))
    return found.select(axis.alias("axis"), F.col("k")[1].alias("route_id"), null(2).alias("service_id"), null(3).cast("int").alias("direction"), null(4).alias("sub_key"), "kind", F.when(by_day, day(F.col("a"))).otherwise(clock(F.col("a"))).alias("from_key"), to.alias("to_key"))


# ---- 6: implausible spikes

LIMITS = {"passenger_counts": (0.0, 400.0), "gps_events": (0.0, 150.0), "delays": (-60.0, 600.0)}


def implausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    def readings(name: str, source: str, record: str, t: Column, value: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.lit(name).alias("measure"), F.col(source).alias("source"), F.col(record).alias("id"), t.cast("long").alias("t"), F.col(value).cast("double").alias("value"))

    rows = (
        readings("passenger_counts", "vehicle_id", "count_id", F.unix_date("service_date"), "max_load")
        .unionByName(readings("gps_events", "vehicle_id", "event_id", micros("event_time"), "speed_kmh"))
        .unionByName(readings("delays", "route_id", "delay_id", micros("scheduled_arrival"), "delay_minutes"))
    )
    return implausible_readings(rows, LIMITS)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible(spark, sf_dir).select(F.col("measure").alias("table_name"), F.col("id").alias("record_key")).distinct()


def p6_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible(spark, sf_dir).groupBy("measure", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))


QUERIES = {
    "p1_found": p1_found, "p1_attributes": p1_attributes, "p2_found": p2_found, "p2_failures": p2_failures,
    **{f"p2_{name}": p2_typed(name) for name in CONTRACTS},
    "p3_found": p3_found, "p3_rolling": p3_rolling, "p4_found": p4_found, "p4_report": p4_report, "p5_found": p5_found, "p6_found": p6_found, "p6_kinds": p6_kinds,
}

SQL = TWINS | {f"p2_{name}": typed_sql(name, c.columns, TYPES[name]) for name, c in CONTRACTS.items()}
