"""Queries of operators that the other catalogues do not use: samples, lags, corrections, comparisons, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareline.functions import expr as E
from fareline.operators import aggregates as A
from fareline.operators import cleaning as C
from fareline.operators import joins as J
from fareline.operators import quality as Q
from fareline.operators import sampling as S
from fareline.operators import windows as W
from fareline.plans import decisions as D
from fareline.plans.catalog import _DAILY, _daily, r6
from fareline.plans.marts import mart
from fareline.plans.transit import of
from fareline.plans.transit_sql import _EVENTS, _RIDES, BASE
from fareline.plans.transit_sql import SQL as TWINS
from fareline.session import table
from fareline.streaming import live

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query of (spark, sf_dir)."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _of(*names: str):
    """Register-ready form of a function of tables."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[table(spark, sf_dir, n) for n in names])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return run

    return wrap


# ---- samples: md5 orders and cuts, so any engine draws the same rows


@query("SELECT DISTINCT ticket_id FROM tickets ORDER BY md5('7|' || ticket_id), ticket_id LIMIT 300")
@_of("tickets")
def sample_hash(tickets):
    return S.hash_sample(tickets.select("ticket_id").distinct(), ["ticket_id"], 300, 7)


@query("SELECT route_id, trip_id FROM (SELECT DISTINCT route_id, trip_id FROM trips) QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY md5('0|' || trip_id), trip_id) <= 20")
@_of("trips")
def sample_per_group(trips):
    return S.hash_sample_per_group(trips.select("route_id", "trip_id").distinct(), ["route_id"], ["trip_id"], 20)


@query("SELECT DISTINCT ticket_id, fare_category FROM tickets WHERE ('0x' || md5('3|' || ticket_id)[1:8])::BIGINT < 4294967296 * CASE fare_category WHEN 'adult' THEN 0.1 WHEN 'senior' THEN 0.5 ELSE 0 END")
@_of("tickets")
def sample_stratified(tickets):
    return S.stratified(tickets.select("ticket_id", "fare_category").distinct(), "fare_category", {"adult": 0.1, "senior": 0.5}, ["ticket_id"], 3)


@query("SELECT DISTINCT trip_id FROM trips WHERE ('0x' || md5('1|' || trip_id)[1:8])::BIGINT < 4294967296 * 0.25")
@_of("trips")
def sample_fraction_by_key(trips):
    return S.fraction_by_key(trips.select("trip_id").distinct(), ["trip_id"], 0.25, 1)


# ---- windows


@query(_DAILY + " SELECT route_id, service_date, round(b / nullif(lag(b, 28) OVER (PARTITION BY route_id ORDER BY d), 0) - 1, 6) AS change FROM r")
@_of("route_daily_boardings")
def win_pct_change(route_daily_boardings):
    return W.relative_change(_daily(route_daily_boardings), ["route_id"], ["d"], "b", 28, "change").select("route_id", "service_date", r6(F.col("change")).alias("change"))


@query(_DAILY + " SELECT route_id, service_date, CASE WHEN count(b) OVER w >= 5 THEN round(avg(b) OVER w, 6) END AS last_28 FROM r WINDOW w AS (PARTITION BY route_id ORDER BY d ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)")
@_of("route_daily_boardings")
def win_min_periods(route_daily_boardings):
    return W.rolling_rows(_daily(route_daily_boardings), ["route_id"], ["d"], "b", 28, "last_28", least=5).select("route_id", "service_date", r6(F.col("last_28")).alias("last_28"))


@query(_DAILY + " SELECT route_id, service_date, b FROM r QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY d DESC) <= 28")
@_of("route_daily_boardings")
def win_last_rows(route_daily_boardings):
    return D.last_rows(_daily(route_daily_boardings), ["route_id"], ["d"], 28).select("route_id", "service_date", "b")


@query("SELECT route_id, list_sort(list(max_load))[(count(max_load) + 1) // 2] AS middle FROM (SELECT DISTINCT * FROM passenger_counts) WHERE max_load IS NOT NULL GROUP BY 1")
@_of("passenger_counts")
def agg_lower_median(passenger_counts):
    """Median of a route's loads, of two middle ones the lower; a route's loads are counted per value, not gathered."""
    from fareline.operators.ranks import exact_quantiles

    return exact_quantiles(passenger_counts.distinct(), ["route_id"], "max_load", [0.5]).withColumnRenamed("q0", "middle")


@query("SELECT value, n FROM (SELECT delay_reason AS value, count(*) AS n FROM delays WHERE delay_reason IS NOT NULL GROUP BY 1) ORDER BY n DESC, value LIMIT 5")
@_of("delays")
def agg_top_values(delays):
    n = delays.where("delay_reason is not null").groupBy(F.col("delay_reason").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "value").limit(5)


# ---- comparisons of two labellings and two stores


@query("SELECT ticket_type, fare_category, count(*) AS n FROM tickets WHERE ticket_type IS NOT NULL AND fare_category IS NOT NULL GROUP BY ALL")
@_of("tickets")
def agg_crosstab(tickets):
    return A.crosstab(tickets, "ticket_type", "fare_category")


@query("""WITH c AS (SELECT ticket_type AS a, fare_category AS b, count(*)::DOUBLE AS n FROM tickets WHERE ticket_type IS NOT NULL AND fare_category IS NOT NULL GROUP BY ALL),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS cells, (SELECT sum(x * (x - 1) / 2) FROM (SELECT sum(n) AS x FROM c GROUP BY a)) AS rows, (SELECT sum(x * (x - 1) / 2) FROM (SELECT sum(n) AS x FROM c GROUP BY b)) AS cols, (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS pairs)
SELECT round((cells - rows * cols / pairs) / nullif((rows + cols) / 2 - rows * cols / pairs, 0), 9) AS adjusted_rand FROM s""")
@_of("tickets")
def agg_adjusted_rand(tickets):
    return A.adjusted_rand(tickets, "ticket_type", "fare_category").withColumn("adjusted_rand", F.round("adjusted_rand", 9))


_CONFUSED = "WITH c AS (SELECT record_source AS l, CASE WHEN delay_minutes > 3 THEN 'avl' ELSE 'manual' END AS p FROM delays WHERE record_source IS NOT NULL)"


def _predicted(delays: DataFrame) -> DataFrame:
    return delays.where("record_source is not null").select(F.col("record_source").alias("l"), F.when(F.col("delay_minutes") > 3, "avl").otherwise("manual").alias("p"))


@query(_CONFUSED + " SELECT l, p, count(*) AS n FROM c GROUP BY ALL")
@_of("delays")
def agg_confusion_matrix(delays):
    return A.crosstab(_predicted(delays), "l", "p")


@query(
    _CONFUSED
    + """, k AS (SELECT l AS class FROM c UNION SELECT p FROM c), f AS (SELECT class, count(*) FILTER (WHERE l = class) AS support, 2 * count(*) FILTER (WHERE l = class AND p = class) / (count(*) FILTER (WHERE l = class) + count(*) FILTER (WHERE p = class)) AS f1 FROM c JOIN k ON l = class OR p = class GROUP BY 1)
SELECT (SELECT round(avg((l = p)::INT), 6) FROM c) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f"""
)
@_of("delays")
def agg_classification_scores(delays):
    s = A.classification_scores(_predicted(delays), "l", "p")
    return s.select(*[r6(F.col(c)).alias(c) for c in s.columns])


@query("SELECT 'trip_id' AS \"column\", count(DISTINCT a.trip_id) AS distinct_a, (SELECT count(DISTINCT trip_id) FROM delays) AS distinct_b, NULL::DOUBLE AS sum_a, NULL::DOUBLE AS sum_b, count(DISTINCT a.trip_id) = (SELECT count(DISTINCT trip_id) FROM delays) AS same FROM passenger_counts a UNION ALL SELECT 'service_date', (SELECT count(DISTINCT service_date) FROM passenger_counts), (SELECT count(DISTINCT service_date) FROM delays), NULL, NULL, (SELECT count(DISTINCT service_date) FROM passenger_counts) = (SELECT count(DISTINCT service_date) FROM delays)")
@_of("passenger_counts", "delays")
def agg_store_parity(passenger_counts, delays):
    return A.store_parity(passenger_counts.select("trip_id", "service_date"), delays.select("trip_id", "service_date"))


@query("SELECT within_5, within_20, n FROM (SELECT round(avg((abs(alightings - boardings) <= 1)::INT), 6) AS within_5, round(avg((abs(alightings - boardings) <= 0.2 * boardings)::INT), 6) AS within_20, count(*) AS n FROM passenger_counts WHERE boardings IS NOT NULL AND alightings IS NOT NULL)")
@_of("passenger_counts")
def agg_band_accuracy(passenger_counts):
    """Shares of predictions within one unit and within a fifth of the value."""
    b = A.band_accuracy(passenger_counts, "boardings", "alightings", {"within_5": (1.0, 0.0), "within_20": (0.0, 0.2)})
    return b.select(*[r6(F.col(c)).alias(c) for c in ("within_5", "within_20")], "n")


# ---- corrections of single values


@query("WITH b AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) < count(*) OR min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*)) SELECT l_orderkey, l_partkey, l_suppkey, l_shipdate, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice)::INT AS line FROM lineitem SEMI JOIN b USING (l_orderkey)")
@_of("lineitem")
def clean_resequenced(lineitem):
    """Line numbers of the orders in which they are not 1..n, counted anew."""
    rule = Q.Rule("S1", "sequence_integrity", "lineitem", params={"group_by": ["l_orderkey"], "sequence_column": "l_linenumber"})
    c = Q.Catalog({"lineitem": lineitem}, {"lineitem": ["l_orderkey"]})
    bad = Q.run_rule(c, rule).select(F.col("record_key").cast("long").alias("l_orderkey"))
    rows, line = C.resequenced("l_linenumber", ["l_orderkey"], ["l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]).apply(lineitem.join(bad, "l_orderkey", "left_semi"))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", line.alias("line"))


@query("SELECT stop_id, CASE WHEN ok THEN longitude END AS latitude, CASE WHEN ok THEN latitude END AS longitude FROM (SELECT *, longitude BETWEEN 11.9 AND 12.6 AND latitude BETWEEN 33.0 AND 33.8 AS ok FROM stops WHERE NOT (latitude BETWEEN 11.9 AND 12.6 AND longitude BETWEEN 33.0 AND 33.8))")
@_of("stops")
def clean_swapped(stops):
    """Stops outside the area: their coordinates the other way round, if both then lie in it."""
    box = [11.9, 12.6, 33.0, 33.8]
    bad = Q.ROW_CHECKS["geo_bounds"]("latitude", "longitude", box).fails
    lat, lon = C.swapped("latitude", "longitude", box)
    rows = stops.where(bad)
    return rows.select("stop_id", lat.apply(rows)[1].alias("latitude"), lon.apply(rows)[1].alias("longitude"))


@query("WITH p AS (SELECT DISTINCT * FROM passenger_counts), m AS (SELECT trip_id, max(boardings) AS most FROM p GROUP BY 1) SELECT count_id, most AS boardings FROM p JOIN m USING (trip_id) WHERE p.boardings IS NULL OR p.boardings < 0")
@_of("passenger_counts")
def clean_from_children(passenger_counts):
    """Missing or negative counts: the greatest count of the same trip."""
    p = passenger_counts.distinct()
    rows, most = C.from_children("boardings", "trip_id", p, "boardings").apply(p.where("boardings is null or boardings < 0").where("trip_id is not null"))
    return rows.select("count_id", most.alias("boardings"))


@query("SELECT delay_id, CASE WHEN delay_minutes IS NULL THEN NULL WHEN delay_minutes < 1 THEN 'on_time' WHEN delay_minutes < 5 THEN 'minor' WHEN delay_minutes < 15 THEN 'major' ELSE 'severe' END AS severity FROM delays")
@_of("delays")
def scalar_severity(delays):
    """Severity of a delay; the bounds must fit the labels that are agreed on, or nothing is labelled at all."""
    return delays.select("delay_id", E.guarded_band(F.col("delay_minutes"), ((1.0, "on_time"), (5.0, "minor"), (15.0, "major"), (None, "severe")), ("on_time", "minor", "major", "severe")).alias("severity"))


@query("SELECT trip_id, actual_departure, actual_arrival FROM trips WHERE actual_departure IS NOT NULL AND actual_arrival IS NOT NULL")
@_of("trips")
def filter_dropna(trips):
    return trips.dropna(subset=["actual_departure", "actual_arrival"]).select("trip_id", "actual_departure", "actual_arrival")


# ---- features that describe, and how much of them is measured


_H = "WITH g AS (SELECT route_id, service_date, hour(entry_time)::INT AS h, count(*) AS n FROM tickets WHERE route_id <> '' AND entry_time IS NOT NULL GROUP BY ALL)"


@query(_H + " SELECT route_id, service_date, h, round(n / sum(n) OVER (PARTITION BY route_id, service_date), 6) AS share, round(n / sum(n) OVER (PARTITION BY route_id, service_date), 6) >= 0.08 AS is_peak FROM g")
@_of("tickets")
def feat_peak_descriptive(tickets):
    """Peak hours of a day by that day itself: for description only, never an input of a model."""
    g = tickets.where("route_id != '' and entry_time is not null").groupBy("route_id", "service_date", F.hour("entry_time").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    s = W.share_of_total(g, ["route_id", "service_date"], "n", "share")
    return s.select("route_id", "service_date", "h", r6(F.col("share")).alias("share"), (r6(F.col("share")) >= 0.08).alias("is_peak"))


_SPLIT = "sp AS (SELECT service_date, CASE WHEN i <= round(n * 0.7) THEN 'train' WHEN i <= round(n * 0.7) + round(n * 0.15) THEN 'validation' ELSE 'test' END AS split FROM (SELECT service_date, row_number() OVER (ORDER BY service_date) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT service_date FROM t WHERE service_date IS NOT NULL)))"


def _split_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fareline.operators.features import split_by_day

    t = mart(spark, sf_dir).trips
    return t.join(split_by_day(t, "service_date", 0.7, 0.15), "service_date")


@query(BASE + ", " + _SPLIT + " SELECT route_id, count(*) AS trips, round(avg(boardings), 4) AS boardings, round(stddev(boardings), 4) AS spread, round(avg(occupancy), 4) AS occupancy, round(avg((delay >= 5)::INT), 4) AS late_share, round(avg((trip_status = 'cancelled')::INT), 4) AS cancelled, count(DISTINCT load_stop) AS load_stops FROM t JOIN sp USING (service_date) WHERE split = 'train' GROUP BY 1")
def feat_route_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of a route from the training days alone."""
    t = _split_trips(spark, sf_dir).where("split = 'train'")
    return t.groupBy("route_id").agg(F.count(F.lit(1)).alias("trips"), *[F.round(c, 4).alias(n) for n, c in (("boardings", F.avg("boardings")), ("spread", F.stddev("boardings")), ("occupancy", F.avg("occupancy")), ("late_share", E.share(F.col("delay") >= 5, F.col("delay"))), ("cancelled", F.avg((F.col("trip_status") == "cancelled").cast("double"))))], F.countDistinct("load_stop").alias("load_stops"))


@query(BASE + ", " + _SPLIT + " SELECT split, dow, h, count(*) AS trips, count(boardings) AS measured, round(avg(boardings), 4) AS boardings, round(avg(occupancy), 4) AS occupancy FROM t JOIN sp USING (service_date) GROUP BY ALL")
def feat_hour_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _split_trips(spark, sf_dir)
    return t.groupBy("split", "dow", "h").agg(F.count(F.lit(1)).alias("trips"), F.count("boardings").alias("measured"), F.round(F.avg("boardings"), 4).alias("boardings"), F.round(F.avg("occupancy"), 4).alias("occupancy"))


@query(BASE + ", " + _SPLIT + " SELECT split, ran, count(*) AS trips, count(boardings) AS counted, count(occupancy) AS with_occupancy, count(delay) AS with_delay, round(count(boardings) / count(*), 4) AS coverage FROM t JOIN sp USING (service_date) GROUP BY ALL")
def feat_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many trips of each split have what is to be predicted."""
    t = _split_trips(spark, sf_dir)
    return t.groupBy("split", "ran").agg(F.count(F.lit(1)).alias("trips"), *[F.count(c).alias(n) for c, n in (("boardings", "counted"), ("occupancy", "with_occupancy"), ("delay", "with_delay"))], F.round(F.count("boardings") / F.count(F.lit(1)), 4).alias("coverage"))


# ---- streams as batches


@query("SELECT event_id, vehicle_id, date_diff('minute', event_time, received_at) > 30 AS late FROM gps_events WHERE vehicle_id <> '' AND date_diff('day', event_time::DATE, received_at::DATE) NOT BETWEEN 0 AND 0")
@_of("gps_events")
def stream_late_split(gps_events):
    """Events that arrive on another day than they happened."""
    days = gps_events.where("vehicle_id != ''").withColumn("day", F.to_date("event_time"))
    _, outside = live.split_late(days, "received_at", "day", 0, 1)
    minute = F.date_trunc("minute", "received_at").cast("timestamp"), F.date_trunc("minute", "event_time").cast("timestamp")
    return outside.where("received_at is not null and event_time is not null").select("event_id", "vehicle_id", ((F.unix_timestamp(minute[0]) - F.unix_timestamp(minute[1])) / 60 > 30).alias("late"))


@query("WITH d AS (SELECT max(service_date) AS last FROM trips), n AS (SELECT last, unnest(generate_series(DATE '2026-11-20', DATE '2026-12-10', INTERVAL 1 DAY))::DATE AS now FROM d) SELECT now, (last - ((dayofweek(last) - dayofweek(now) + 7) % 7)::INT)::DATE AS shown FROM n")
@_of("trips")
def stream_follow_clock(trips):
    """The day of the tables that is shown on a day of the calendar: the last one of the same weekday."""
    span = trips.agg(F.max("service_date").alias("last")).withColumn("now", F.explode(F.sequence(F.lit("2026-11-20").cast("date"), F.lit("2026-12-10").cast("date"))))
    return span.select("now", live.same_weekday(F.col("now"), F.col("last")).alias("shown"))


# ---- decisions


@query(BASE + _RIDES + ", a AS (SELECT route_id, sum(boardings)::DOUBLE AS a FROM t WHERE boardings IS NOT NULL GROUP BY 1), b AS (SELECT ride.route_id, round(sum(factor), 3) AS b FROM ride JOIN (SELECT trip_id FROM t WHERE boardings IS NOT NULL) USING (trip_id) GROUP BY 1) SELECT coalesce(a.route_id, b.route_id) AS route_id, a, b, CASE WHEN b.route_id IS NULL THEN 'only_a' WHEN a.route_id IS NULL THEN 'only_b' WHEN abs(a - b) <= 0.1 * greatest(abs(a), abs(b)) THEN 'agree' ELSE 'differ' END AS status FROM a FULL JOIN b ON a.route_id = b.route_id")
def decide_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boardings of routes as counted against the expanded taps of the same trips, to a tenth."""
    m = mart(spark, sf_dir)
    counted = m.trips.where("boardings is not null")
    a = counted.groupBy("route_id").agg(F.sum("boardings").cast("double").alias("boardings"))
    b = m.rides.join(counted.select("trip_id"), "trip_id", "left_semi").groupBy("route_id").agg(F.round(F.sum("factor"), 3).alias("boardings"))
    return D.agreement(a, b, ["route_id"], "boardings", 0.1)


_CONTEXT = BASE + ", x AS (SELECT route_id, direction, dow, h, count(*) AS trips, round(avg(boardings), 4) AS boardings, round(avg(occupancy), 4) AS occupancy, round(avg(delay), 4) AS delay FROM t WHERE day_no > (SELECT max(day_no) FROM t) - 56 GROUP BY ALL)"


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips of the last eight weeks by route, direction, weekday and hour."""
    t = mart(spark, sf_dir).trips
    last = t.agg(F.max("day_no")).scalar()
    return t.where(F.col("day_no") > last - 56).groupBy("route_id", "direction", "dow", "h").agg(F.count(F.lit(1)).alias("trips"), *[F.round(F.avg(c), 4).alias(c) for c in ("boardings", "occupancy", "delay")])


@query(_CONTEXT + " SELECT * FROM x")
def decide_context_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir)


@query(_CONTEXT + " SELECT false AS found, h AS value FROM x WHERE route_id = (SELECT min(route_id) FROM t) AND direction = 0 AND dow = 2 GROUP BY h HAVING NOT EXISTS (SELECT 1 FROM x WHERE route_id = (SELECT min(route_id) FROM t) AND direction = 0 AND dow = 2 AND h = 3)")
def decide_find_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell that does not exist (three at night): the hours there are on that route, direction and weekday."""
    first = mart(spark, sf_dir).trips.agg(F.min("route_id")).scalar()
    return D.find_cell(_context(spark, sf_dir), {"route_id": first, "direction": 0, "dow": 2, "h": 3}, "h")


_RISK = "round(coalesce(occupancy, 0) * 60 + least(coalesce(delay, 0), 30) / 30 * 40, 2)"


@query(_CONTEXT + f" SELECT route_id, direction, h, trips, {_RISK} AS risk FROM x WHERE dow = 2 ORDER BY {_RISK} DESC, route_id, direction, h LIMIT 50")
def decide_risk_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of a weekday by risk: load and lateness on one scale of 100."""
    risk = F.round(F.coalesce("occupancy", F.lit(0)) * 60 + F.least(F.coalesce("delay", F.lit(0)), F.lit(30)) / 30 * 40, 2)
    return _context(spark, sf_dir).where("dow = 2").select("route_id", "direction", "h", "trips", risk.alias("risk")).orderBy(F.desc("risk"), "route_id", "direction", "h").limit(50)


@query("WITH a AS (SELECT route_id, direction, count(*) AS trips FROM (SELECT DISTINCT * FROM trips) WHERE trip_status = 'cancelled' GROUP BY ALL), b AS (SELECT route_id, direction, count(*) AS windows FROM (SELECT DISTINCT * FROM schedules) GROUP BY ALL) SELECT route_id, direction, trips, windows FROM a JOIN b USING (route_id, direction)")
@_of("trips", "schedules")
def join_two_results(trips, schedules):
    a = trips.distinct().where("trip_status = 'cancelled'").groupBy("route_id", "direction").agg(F.count(F.lit(1)).alias("trips"))
    b = schedules.distinct().groupBy("route_id", "direction").agg(F.count(F.lit(1)).alias("windows"))
    return J.inner_on(a, b, ["route_id", "direction"])


@query("WITH e AS (SELECT DISTINCT trip_id, event_time, event_id, longitude AS x, latitude AS y FROM gps_events WHERE trip_id <> '' AND longitude IS NOT NULL AND latitude IS NOT NULL), o AS (SELECT trip_id, event_id, min(event_time) AS t, arg_min(x, event_time) AS x, arg_min(y, event_time) AS y FROM e GROUP BY ALL) SELECT trip_id, '{\"type\":\"LineString\",\"coordinates\":[' || string_agg('[' || round(x, 5) || ',' || round(y, 5) || ']', ',' ORDER BY t, event_id) || ']}' AS geometry FROM o GROUP BY 1")
@_of("gps_events")
def geo_vehicle_lines(gps_events):
    """The way of a trip in the order of time; an event counts once."""
    e = gps_events.where("trip_id != '' and longitude is not null and latitude is not null").groupBy("trip_id", "event_id").agg(F.min("event_time").alias("t"), F.min_by("longitude", "event_time").alias("x"), F.min_by("latitude", "event_time").alias("y"))
    return D.lines_geojson(e, ["trip_id"], ["t", "event_id"], "x", "y")


@query(BASE + _EVENTS + ", m AS (SELECT state, count(*) AS n, round(avg(against), 4) AS against FROM ev GROUP BY 1) SELECT state AS grp, 'n' AS metric, n::DOUBLE AS value FROM m UNION ALL SELECT state, 'against', against FROM m WHERE against IS NOT NULL")
def agg_flat_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of groups as rows (grp, metric, value), from a map per group."""
    g = mart(spark, sf_dir).route_days.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("against"), 4).alias("against"))
    return A.flat_metrics(g, "state", ["n", "against"]).withColumnRenamed("state", "grp")


_SCENARIOS = {
    "more_trips": ("trips * 1.25", "per_trip * 1.1 / 1.25", "size"),
    "fewer_trips": ("trips * 0.8", "per_trip / 0.8 * 0.95", "size"),
    "larger_vehicle": ("trips * 1.0", "per_trip * 1.0", "size * 1.5"),
    "smaller_vehicle": ("trips * 1.0", "per_trip * 1.0", "size * 0.7"),
    "demand_up": ("trips * 1.0", "per_trip * 1.2", "size"),
    "demand_down": ("trips * 1.0", "per_trip * 0.8", "size"),
    "skip_direction": ("trips * 0.5", "per_trip * 1.5", "size"),
    "split_vehicle": ("trips * 2.0", "per_trip * 0.5", "size * 0.6"),
}


@query(
    BASE
    + ", l AS (SELECT route_id, direction, count(*) FILTER (WHERE ran)::DOUBLE AS trips, avg(boardings) AS per_trip, avg(capacity) AS size FROM t GROUP BY ALL HAVING count(boardings) > 0 AND count(capacity) > 0), s AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS scenario, route_id, direction, per_trip / size AS load_before, ({b}) / ({c}) AS load_after, trips * per_trip AS moved_before, ({a}) * ({b}) AS moved_after FROM l" for k, (a, b, c) in _SCENARIOS.items())
    + ") SELECT scenario, route_id, direction, round(load_before, 4) AS load_before, round(load_after, 4) AS load_after, round(load_after - load_before, 4) AS load_change, round(moved_before, 2) AS moved_before, round(moved_after, 2) AS moved_after FROM s"
)
def decide_whatif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight scenarios on every route and direction: load of a vehicle and people moved, before and after."""
    t = mart(spark, sf_dir).trips
    base = t.groupBy("route_id", "direction").agg(F.count(F.when(F.col("ran"), 1)).cast("double").alias("trips"), F.avg("boardings").alias("per_trip"), F.avg("capacity").alias("size")).where("per_trip is not null and size is not null")
    results = {"load": F.col("per_trip") / F.col("size"), "moved": F.col("trips") * F.col("per_trip")}
    parts = [D.scenario(base, {"trips": F.expr(a), "per_trip": F.expr(b), "size": F.expr(c)}, results).withColumn("scenario", F.lit(k)) for k, (a, b, c) in _SCENARIOS.items()]
    digits = {"load_before": 4, "load_after": 4, "load_change": 4, "moved_before": 2, "moved_after": 2}
    return A.union_all(parts).select("scenario", "route_id", "direction", *[F.round(c, n).alias(c) for c, n in digits.items()])


@query(BASE + _RIDES + """, sf AS (SELECT entry_stop_id AS stop_id, entry_period AS period, service_date, count(*) AS n FROM ride WHERE entry_period IS NOT NULL GROUP BY ALL),
g AS (SELECT stop_id, period, unnest(generate_series((SELECT min(service_date) FROM sf), (SELECT max(service_date) FROM sf), INTERVAL 1 DAY))::DATE AS service_date FROM (SELECT DISTINCT stop_id, period FROM sf)),
d AS (SELECT g.*, coalesce(n, 0) AS n FROM g LEFT JOIN sf USING (stop_id, period, service_date))
SELECT *, lag(n) OVER w AS n_lag_1, lag(n, 7) OVER w AS n_lag_7 FROM d WINDOW w AS (PARTITION BY stop_id, period ORDER BY service_date)""")
def feat_stop_period_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taps of every stop and period on every day, days without a tap included, with their lags."""
    f = mart(spark, sf_dir).rides.where("entry_period is not null").groupBy(F.col("entry_stop_id").alias("stop_id"), F.col("entry_period").alias("period"), "service_date").agg(F.count(F.lit(1)).alias("n"))
    return W.lags(J.dense_grid(f, ["stop_id", "period"], "service_date", ["n"]), ["stop_id", "period"], ["service_date"], "n", (1, 7))


#: The joins of the tables: (name, left table, its column, right table, its column).
JOINS = (
    ("tickets_trips", "tickets", "trip_id", "trips", "trip_id"), ("trips_routes", "trips", "route_id", "routes", "route_id"), ("trips_vehicles", "trips", "vehicle_id", "vehicles", "vehicle_id"),
    ("trips_schedules", "trips", "schedule_id", "schedules", "schedule_id"), ("tickets_stops", "tickets", "entry_stop_id", "stops", "stop_id"), ("routes_stops", "routes", "origin_stop_id", "stops", "stop_id"),
    ("delays_trips", "delays", "trip_id", "trips", "trip_id"), ("counts_trips", "passenger_counts", "trip_id", "trips", "trip_id"), ("events_stops", "gps_events", "stop_id", "stops", "stop_id"),
)


@query(" UNION ALL ".join(f"SELECT '{n}' AS pair, count(*) AS left_rows, sum(coalesce(n, 1))::BIGINT AS output_rows, count(*) FILTER (WHERE n IS NULL) AS orphans FROM {a} l LEFT JOIN (SELECT {y} AS k, count(*) AS n FROM {b} GROUP BY 1) r ON l.{x} = r.k" for n, a, x, b, y in JOINS))
def join_measured_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine joins between the tables: what goes in, what comes out, what finds nothing."""
    parts = []
    for name, a, x, b, y in JOINS:
        left, right = table(spark, sf_dir, a).select(F.col(x).alias("k")), table(spark, sf_dir, b).select(F.col(y).alias("k"))
        parts.append(J.measured_left_join(left, right, ["k"]).select(F.lit(name).alias("pair"), "*"))
    return A.union_all(parts)


_CELL = "concat_ws('/', route_id, direction, day_class, period)"


@query(
    " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, {entity} AS entity, round({evidence}, 4)::DOUBLE AS evidence, {priority}::INT AS priority FROM ({source}) WHERE {when}"
        for kind, source, entity, when, evidence, priority in (
            ("more_trips", TWINS["an_service_frequency"], _CELL, "state = 'too_little'", "occupancy", 1),
            ("fewer_trips", TWINS["an_service_frequency"], _CELL, "state = 'too_much'", "occupancy", 3),
            ("larger_vehicle", TWINS["an_demand_supply_gap"], _CELL, "suggestion = 'larger'", "utilisation", 1),
            ("smaller_vehicle", TWINS["an_demand_supply_gap"], _CELL, "suggestion = 'smaller'", "utilisation", 3),
            ("lasting_overload", TWINS["an_persistent_overcrowding"], "concat_ws('/', route_id, direction, dow, period)", "pattern = 'persistent'", "part", 0),
            ("bottleneck", TWINS["an_delay_by_stop"], "stop_id", "bottleneck", "congestion_rate", 2),
            ("often_odd", f"SELECT entity, count(*) AS n FROM ({TWINS['an_anomalies']}) GROUP BY 1", "entity", "n >= 5", "n", 4),
        )
    )
)
def decide_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on the results of the statements: which fire where, and by what number."""
    m = mart(spark, sf_dir)
    from fareline.plans import transit

    transit.register(m)
    cell = F.concat_ws("/", "route_id", "direction", "day_class", "period")
    frequency, gap, lasting = of(m, "an_service_frequency"), of(m, "an_demand_supply_gap"), of(m, "an_persistent_overcrowding")
    odd = of(m, "an_anomalies").groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    rules = [
        D.Rule("more_trips", frequency, cell, F.col("state") == "too_little", F.col("occupancy"), 1), D.Rule("fewer_trips", frequency, cell, F.col("state") == "too_much", F.col("occupancy"), 3),
        D.Rule("larger_vehicle", gap, cell, F.col("suggestion") == "larger", F.col("utilisation"), 1), D.Rule("smaller_vehicle", gap, cell, F.col("suggestion") == "smaller", F.col("utilisation"), 3),
        D.Rule("lasting_overload", lasting, F.concat_ws("/", "route_id", "direction", "dow", "period"), F.col("pattern") == "persistent", F.col("part"), 0),
        D.Rule("bottleneck", of(m, "an_delay_by_stop"), F.col("stop_id"), F.col("bottleneck"), F.col("congestion_rate"), 2), D.Rule("often_odd", odd, F.col("entity"), F.col("n") >= 5, F.col("n"), 4),
    ]
    return D.fired(rules).select("kind", "entity", F.round("evidence", 4).alias("evidence"), "priority")
