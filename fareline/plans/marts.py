"""Relations that many transit statements share, built once per session and folder of tables and stored.

A statement reads the stored relation and not its plan, so each source table is scanned once for all of them.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fareline.functions import expr as E
from fareline.operators.features import peak_share
from fareline.operators.windows import history_median
from fareline.session import stored, table

# Public holidays of the period, as exceptions of the service calendar (day, kind, name).
EXCEPTIONS = (
    ("2024-01-01", "added", "New Year"), ("2024-05-01", "added", "Labour Day"), ("2024-12-25", "added", "Christmas Day"),
    ("2024-12-26", "added", "Second Christmas Day"), ("2024-02-29", "removed", "Leap Day"),
)
#: Loads over capacity, by band.
BANDS = ((0.25, "low"), (0.75, "normal"), (1.0, "high"), (None, "over"))
#: Hours of a day that each period has.
HOURS = {name: high - low + 1 for low, high, name in E.PERIODS}
#: Taps below which a cell takes the factor of its route and month, and that of its month.
LEAST_TAPS = 30


def seconds(start: str, end: str) -> Column:
    """Whole seconds between two times."""
    return F.unix_timestamp(F.col(end).cast("timestamp")) - F.unix_timestamp(F.col(start).cast("timestamp"))


def weekend(day: str) -> Column:
    return F.dayofweek(day).isin(1, 7)


class Mart:
    """The shared relations of one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def holidays(self) -> DataFrame:
        """(service_date, holiday): days that the calendar's exceptions add to the holiday service."""
        rows = [(dt.date.fromisoformat(day), kind, name) for day, kind, name in EXCEPTIONS]
        given = self.spark.createDataFrame(rows, "service_date date, kind string, holiday string")
        return given.where("kind = 'added'").groupBy("service_date").agg(F.max("holiday").alias("holiday"))

    @cached_property
    def trips(self) -> DataFrame:
        """A trip per row, with its count, delay, vehicle, route, schedule, day and as-of peak flag."""
        trip = self.table("trips").where("route_id != ''").distinct()
        counts = self.table("passenger_counts").where("boardings >= 0 and max_load between 0 and 400")
        counted = counts.groupBy("trip_id").agg(F.max("boardings").alias("boardings"), F.max("max_load").alias("max_load"), F.max("denied_boardings").alias("denied"), F.max_by("max_load_stop_id", F.struct("max_load", "max_load_stop_id")).alias("load_stop"))
        late = self.table("delays").where("delay_minutes between -60 and 600").distinct().groupBy("trip_id").agg(F.round(F.avg("delay_minutes"), 6).alias("delay"))  # held against thresholds later
        fleet = self.table("vehicles").groupBy("vehicle_id").agg(F.max_by("capacity_total", F.struct("effective_from", "recorded_at", "version_id")).alias("capacity"))
        planned = self.table("schedules").where("schedule_id != ''").groupBy("schedule_id").agg(F.max("headway_min").alias("headway"), F.max("planned_runtime_min").alias("runtime"))
        routes = self.table("routes").where("route_id != ''").groupBy("route_id").agg(F.max("route_type").alias("route_type"), F.max(F.when(F.col("distance_km").between(0.1, 200), F.col("distance_km"))).alias("distance_km"))
        taps = self.table("tickets").where("route_id != '' and entry_time is not null").select("route_id", "service_date", F.hour("entry_time").alias("h"), weekend("service_date").alias("weekend"), F.lit(1).alias("n"))
        peaks = peak_share(taps, "route_id", "service_date", "h", "weekend", "n").select("route_id", "service_date", "h", F.round("share_asof", 6).alias("peak_share"))
        t = trip.join(counted, "trip_id", "left").join(late, "trip_id", "left").join(fleet, "vehicle_id", "left").join(planned, "schedule_id", "left").join(routes, "route_id", "left").join(self.holidays, "service_date", "left")
        t = t.withColumn("h", F.hour("scheduled_departure")).join(peaks, ["route_id", "service_date", "h"], "left")
        t = t.withColumns({"occupancy": E.ratio(F.col("max_load"), F.col("capacity")), "planned_s": seconds("scheduled_departure", "scheduled_arrival"), "travelled_s": seconds("actual_departure", "actual_arrival"), "arrival_s": seconds("scheduled_arrival", "actual_arrival"), "departure_s": seconds("scheduled_departure", "actual_departure")})
        t = t.withColumns({"planned": F.col("planned_s") / 60.0, "travelled": F.col("travelled_s") / 60.0, "arrival_late": F.col("arrival_s") / 60.0, "departure_late": F.col("departure_s") / 60.0})
        columns = ["trip_id", "route_id", "direction", "service_date", "service_id", "vehicle_id", "schedule_id", "trip_status", "trip_type", "scheduled_departure", "scheduled_arrival", "actual_departure", "h", "planned_s", "travelled_s", "arrival_s", "departure_s", "planned", "travelled", "arrival_late", "departure_late", "boardings", "max_load", "denied", "load_stop", "delay", "capacity", "occupancy", "headway", "runtime", "route_type", "distance_km", "holiday", "peak_share"]
        return stored(
            t.select(
                *columns, F.date_format("service_date", "yyyy-MM").alias("ym"), F.dayofweek("service_date").alias("dow"), F.unix_date("service_date").alias("day_no"), F.col("trip_status").isin("completed", "partial").alias("ran"),
                E.day_period(F.col("h"), E.PERIODS).alias("period"), F.when(F.col("holiday").isNotNull(), "holiday").when(weekend("service_date"), "weekend").otherwise("weekday").alias("day_class"),
                E.band(F.col("occupancy"), BANDS).alias("band"), (F.col("peak_share") >= 0.08).alias("peak"),
            )
        )

    @cached_property
    def taps(self) -> DataFrame:
        """A tap per row, those without a trip or an entry left out."""
        k = self.table("tickets").where("trip_id != '' and entry_stop_id != ''")
        return stored(k.select("ticket_id", "passenger_id", "trip_id", "route_id", "service_date", "entry_stop_id", "exit_stop_id", "entry_time", "exit_time", "fare_category").distinct())

    @cached_property
    def factors(self) -> DataFrame:
        """Boardings counted per tap, by route, month and period; of trips with a count on both sides. Thin
        cells take the factor of their route and month, or of the month. The coarser sums are windows over the cells."""
        n = self.taps.groupBy("trip_id").agg(F.count(F.lit(1)).alias("n"))
        counted = self.trips.where("boardings is not null").join(n, "trip_id", "left").groupBy("route_id", "ym", "period").agg(F.sum("boardings").alias("counted"), F.sum(F.coalesce("n", F.lit(0))).alias("taps"))
        all_cells = self.trips.select("route_id", "ym", "period").distinct().join(counted, ["route_id", "ym", "period"], "left")
        levels = {"route": Window.partitionBy("route_id", "ym"), "month": Window.partitionBy("ym")}  # cells, not rows
        c = all_cells.withColumns({f"{x}_{level}": F.sum(x).over(w) for level, w in levels.items() for x in ("counted", "taps")})
        enough, of_route = F.col("taps") >= LEAST_TAPS, F.col("taps_route") >= LEAST_TAPS
        factor = F.when(enough, E.ratio(F.col("counted"), F.col("taps"))).when(of_route, E.ratio(F.col("counted_route"), F.col("taps_route"))).otherwise(E.ratio(F.col("counted_month"), F.col("taps_month")))
        return stored(c.select("route_id", "ym", "period", "counted", "taps", factor.alias("factor"), F.when(enough, "cell").when(of_route, "route_month").otherwise("month").alias("factor_level")))

    @cached_property
    def places(self) -> DataFrame:
        """(route_id, direction, stop_id, place, seq, stops): the stops of a route and direction in the order in
        which its vehicles reach them. place: mean share of the planned time, in millionths."""
        g = self.table("gps_events").where("stop_id != '' and trip_id != ''").select("event_id", "trip_id", "stop_id", "event_time").distinct()
        at = g.join(self.trips.select("trip_id", "route_id", "direction", "scheduled_departure", "planned_s"), "trip_id").where("planned_s > 0 and direction is not null")
        way = F.unix_timestamp(F.col("event_time").cast("timestamp")) - F.unix_timestamp(F.col("scheduled_departure").cast("timestamp"))
        share = F.expr("least(greatest(__s, 0), planned_s) * 1000000 div planned_s")
        p = at.withColumn("__s", way).groupBy("route_id", "direction", "stop_id").agg((F.sum(share).alias("s")), F.count(F.lit(1)).alias("n"))
        line = Window.partitionBy("route_id", "direction")  # the stops of one line
        p = p.select("route_id", "direction", "stop_id", F.expr("s div n").alias("place"))
        return stored(p.withColumns({"seq": F.row_number().over(line.orderBy("place", "stop_id")), "stops": F.count(F.lit(1)).over(line).cast("int")}))

    @cached_property
    def rides(self) -> DataFrame:
        """Taps with their trip, factor, time on board and length: along the route if it serves both stops, else
        in a straight line."""
        t = self.trips.select("trip_id", F.col("route_id").alias("r"), "direction", "route_type", "distance_km", F.col("service_date").alias("d"), "dow", "day_no", "ym", "period", "day_class", F.col("service_id").alias("day_type"))
        k = self.taps.drop("route_id", "service_date").join(t, "trip_id").withColumnsRenamed({"r": "route_id", "d": "service_date"})
        k = k.join(self.factors.select("route_id", "ym", "period", "factor"), ["route_id", "ym", "period"])
        stops = self.table("stops")
        for end in ("entry", "exit"):
            place = self.places.select("route_id", "direction", F.col("stop_id").alias(f"{end}_stop_id"), F.col("place").alias(f"{end}_place"))
            site = stops.select(F.col("stop_id").alias(f"{end}_stop_id"), F.col("latitude").alias(f"{end}_y"), F.col("longitude").alias(f"{end}_x"))
            k = k.join(place, ["route_id", "direction", f"{end}_stop_id"], "left").join(site, f"{end}_stop_id", "left")
        along = F.abs(F.col("exit_place") - F.col("entry_place")) / 1e6 * F.col("distance_km")
        straight = E.haversine_km(F.col("entry_y"), F.col("entry_x"), F.col("exit_y"), F.col("exit_x"))
        columns = ["ticket_id", "passenger_id", "trip_id", "route_id", "direction", "route_type", "service_date", "dow", "day_no", "ym", "period", "day_class", "day_type", "entry_stop_id", "exit_stop_id", "entry_time", "exit_time", "fare_category", "factor"]
        return stored(
            k.select(
                *columns, F.hour("entry_time").alias("entry_h"), E.day_period(F.hour("entry_time"), E.PERIODS).alias("entry_period"), E.day_period(F.hour("exit_time"), E.PERIODS).alias("exit_period"),
                seconds("entry_time", "exit_time").alias("ride_s"), F.coalesce(along, straight).alias("km"),
            )
        )

    @cached_property
    def route_days(self) -> DataFrame:
        """Demand of a route and day against the median of the same weekday and service, 56 to 7 days before."""
        t = self.trips
        per_service = t.groupBy("service_date", "service_id").agg(F.count(F.lit(1)).alias("n"))
        kinds = per_service.groupBy("service_date").agg(F.max_by("service_id", F.struct("n", "service_id")).alias("day_type"))
        d = t.groupBy("route_id", "service_date", "dow", "day_no", "holiday").agg(F.sum("boardings").alias("b"), F.count("boardings").alias("measured"), F.count(F.when(F.col("ran"), 1)).alias("operated"), F.count(F.when(F.col("trip_type") == "extra", 1)).alias("extra_trips"))
        d = d.where("measured > 0").withColumn("demand", E.ratio(F.col("b") * F.col("operated"), F.col("measured"))).join(kinds, "service_date")
        d = history_median(d, ["route_id", "dow", "day_type"], "day_no", "demand", -56, -7, "expected")
        against = F.round(E.ratio(F.col("demand"), F.col("expected")), 6)
        state = F.when(F.col("expected_n") < 4, "unknown").when(against >= 1.5, "spike").when(against <= 0.5, "drop").otherwise("normal")
        return stored(d.select("route_id", "service_date", "dow", "day_type", "holiday", "operated", "measured", "extra_trips", "demand", F.col("expected_n").alias("n"), "expected", against.alias("against"), state.alias("state")))

    @cached_property
    def normal_days(self) -> DataFrame:
        """(route_id, service_date): days that are neither a spike, a drop nor a holiday."""
        return self.route_days.where("state not in ('spike', 'drop') and holiday is null").select("route_id", "service_date")


_MARTS: dict[tuple, Mart] = {}


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the tables in a folder: a mart lasts as long as they stay the same."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def mart(spark: SparkSession, sf_dir: str) -> Mart:
    """The mart of the folder, built at most once per application and state of its tables."""
    key = (spark.sparkContext.applicationId, sf_dir, _stamp(spark, sf_dir))
    if key not in _MARTS:
        _MARTS[key] = Mart(spark, sf_dir)
    return _MARTS[key]
