"""Queries of the single operators, each with an SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fareline.functions import expr as E
from fareline.operators import aggregates as A
from fareline.operators import cleaning as C
from fareline.operators import features as X
from fareline.operators import joins as J
from fareline.operators import quality as Q
from fareline.operators import ranks as R
from fareline.operators import windows as W
from fareline.plans.problem_sql import _LINES
from fareline.plans.serving import View, filtered, ordered
from fareline.session import stored, table
from fareline.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BANDS = ((10.0, "low"), (30.0, "middle"), (None, "high"))


def query(sql: str | None = None) -> Callable[[Callable], Callable]:
    """Register a query whose parameters after the first name the tables it reads."""

    def register(f: Callable) -> Callable:
        names = f.__code__.co_varnames[: f.__code__.co_argcount]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[table(spark, sf_dir, n) for n in names])

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c: Column) -> Column:
    return F.round(c, 6)


# ---- scans, projections, scalars


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_returnflag IN ('A', 'R')")
def scan_project_filter(lineitem):
    return lineitem.where("l_shipdate >= timestamp_ntz'1998-01-01' and l_returnflag in ('A', 'R')").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("twice"))


@query("SELECT CASE WHEN l_quantity IS NULL THEN NULL WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'middle' ELSE 'high' END AS band, CASE WHEN hour(e) <= 6 THEN 'early' WHEN hour(e) <= 9 THEN 'am_peak' WHEN hour(e) <= 15 THEN 'midday' WHEN hour(e) <= 18 THEN 'pm_peak' ELSE 'evening' END AS period, count(*) AS n FROM (SELECT l_quantity, l_shipdate + to_hours(CAST(l_linenumber * 3 AS BIGINT)) AS e FROM lineitem) GROUP BY ALL")
def scalar_banding(lineitem):
    at = F.col("l_shipdate").cast("timestamp") + F.make_interval(hours=F.col("l_linenumber") * 3)
    return lineitem.groupBy(E.band(F.col("l_quantity"), BANDS).alias("band"), E.day_period(F.hour(at), E.PERIODS).alias("period")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT trip_id, strftime(service_date, '%Y-%m') AS ym, CAST(dayofweek(service_date) + 1 AS INT) AS dow, CAST(hour(scheduled_departure) AS INT) AS h, round((epoch_us(scheduled_arrival) - epoch_us(scheduled_departure)) / 6e7, 6) AS planned, service_date + 1 AS next_day, CAST(date_diff('day', DATE '2000-01-01', service_date) AS INT) AS day_no FROM trips")
def scalar_dates(trips):
    return trips.select("trip_id", F.date_format("service_date", "yyyy-MM").alias("ym"), F.dayofweek("service_date").alias("dow"), F.hour("scheduled_departure").alias("h"), r6(E.minutes_between(F.col("scheduled_departure"), F.col("scheduled_arrival"))).alias("planned"), F.date_add("service_date", 1).alias("next_day"), F.datediff("service_date", F.lit("2000-01-01").cast("date")).alias("day_no"))


@query("SELECT stop_id, upper(trim(stop_name)) AS name, CAST(length(stop_name) AS INT) AS letters, lpad(zone, 3, '0') AS zone3, split_part(stop_name, ' ', 1) AS first_word, stop_id || '/' || zone AS code FROM stops WHERE stop_name LIKE '%Station%' OR stop_name LIKE '%Square%'")
def scalar_strings(stops):
    return stops.where(F.col("stop_name").like("%Station%") | F.col("stop_name").like("%Square%")).select("stop_id", F.upper(F.trim("stop_name")).alias("name"), F.length("stop_name").alias("letters"), F.lpad("zone", 3, "0").alias("zone3"), F.split_part("stop_name", F.lit(" "), F.lit(1)).alias("first_word"), F.concat("stop_id", F.lit("/"), "zone").alias("code"))


@query("SELECT r.route_id, round(2 * 6371e0 * asin(least(1e0, sqrt(pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2)))), 4) AS km FROM routes r JOIN stops a ON r.origin_stop_id = a.stop_id JOIN stops b ON r.destination_stop_id = b.stop_id")
def scalar_haversine(routes, stops):
    a = stops.select(F.col("stop_id").alias("origin_stop_id"), F.col("latitude").alias("y1"), F.col("longitude").alias("x1"))
    b = stops.select(F.col("stop_id").alias("destination_stop_id"), F.col("latitude").alias("y2"), F.col("longitude").alias("x2"))
    km = E.haversine_km(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2"))
    return routes.join(a, "origin_stop_id").join(b, "destination_stop_id").select("route_id", F.round(km, 4).alias("km"))


@query("SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total, count(json_extract_string(props, '$.none')) AS none FROM events GROUP BY ALL")
def scalar_json(events):
    return events.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"), F.count(F.get_json_object("props", "$.none")).alias("none"))


@query("SELECT route_id, direction, len(days) AS n_days, list_contains(days, 'SAT_Y24') AS on_saturday, array_to_string(list_sort(days), ',') AS services FROM (SELECT route_id, direction, list(DISTINCT service_id) FILTER (WHERE service_id IS NOT NULL) AS days FROM schedules GROUP BY ALL)")
def scalar_arrays(schedules):
    g = schedules.groupBy("route_id", "direction").agg(F.collect_set("service_id").alias("days"))
    return g.select("route_id", "direction", F.size("days").cast("long").alias("n_days"), F.array_contains("days", "SAT_Y24").alias("on_saturday"), F.array_join(F.array_sort("days"), ",").alias("services"))


@query("SELECT record_source, count(*) AS n, count(*) FILTER (WHERE trim(route_id) = '' OR route_id IS NULL) AS blank_route FROM delays WHERE delay_reason IN ('weather', 'traffic') GROUP BY ALL")
def filter_blank_and_in(delays):
    return delays.where(F.col("delay_reason").isin("weather", "traffic")).groupBy("record_source").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(E.is_blank(F.col("route_id")), 1)).alias("blank_route"))


@query("SELECT DISTINCT route_type, status FROM routes")
def agg_distinct_rows(routes):
    return routes.select("route_type", "status").distinct()


# ---- joins


@query("SELECT o.o_orderkey, o.o_custkey, c.c_name, n.n_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey")
def join_left_enrich(orders, customer, nation):
    c = customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left").select("c_custkey", "c_name", "n_name")
    return orders.join(c, orders.o_custkey == c.c_custkey, "left").select("o_orderkey", "o_custkey", "c_name", "n_name")


@query("WITH j AS (SELECT t.rowid AS r, p.trip_id AS hit FROM passenger_counts_rows t LEFT JOIN trips p ON t.trip_id = p.trip_id) SELECT count(DISTINCT r) AS left_rows, count(*) AS output_rows, count(DISTINCT r) FILTER (WHERE hit IS NULL) AS orphans FROM j".replace("passenger_counts_rows", "(SELECT row_number() OVER () AS rowid, trip_id FROM passenger_counts)"))
def join_measured(passenger_counts, trips):
    return J.measured_left_join(passenger_counts.select("trip_id"), trips.select("trip_id"), ["trip_id"])


@query("SELECT DISTINCT ticket_id, trip_id FROM tickets WHERE trip_id IS NOT NULL AND trip_id NOT IN (SELECT trip_id FROM trips)")
def join_orphans_anti(tickets, trips):
    return tickets.where("trip_id is not null").join(trips.select("trip_id").distinct(), "trip_id", "left_anti").select("ticket_id", "trip_id").distinct()


@query("SELECT DISTINCT trip_id, route_id FROM trips WHERE trip_id IN (SELECT trip_id FROM delays WHERE delay_minutes >= 20)")
def join_semi(trips, delays):
    return trips.join(delays.where("delay_minutes >= 20"), "trip_id", "left_semi").select("trip_id", "route_id").distinct()


@query("WITH i AS (SELECT entry_stop_id AS s, count(*) AS n FROM tickets GROUP BY 1), o AS (SELECT exit_stop_id AS s, count(*) AS n FROM tickets GROUP BY 1) SELECT coalesce(i.s, o.s) AS stop_id, coalesce(i.n, 0) AS n_in, coalesce(o.n, 0) AS n_out FROM i FULL JOIN o ON i.s = o.s")
def join_full_patterns(tickets):
    i = tickets.groupBy(F.col("entry_stop_id").alias("s")).agg(F.count(F.lit(1)).alias("n_in"))
    o = tickets.groupBy(F.col("exit_stop_id").alias("s")).agg(F.count(F.lit(1)).alias("n_out"))
    return i.join(o, "s", "full").select(F.col("s").alias("stop_id"), F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


@query("SELECT o_orderpriority, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS part FROM orders GROUP BY ALL")
def join_scalar(orders):
    total = orders.agg(F.count(F.lit(1))).scalar()
    return orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).select("o_orderpriority", "n", r6(F.col("n") / total).alias("part"))


@query("WITH need AS (SELECT route_id, max(max_load) AS need FROM passenger_counts WHERE max_load BETWEEN 0 AND 400 GROUP BY 1), s AS (SELECT capacity_total, min(vehicle_type) AS vehicle_type FROM vehicles WHERE capacity_total IS NOT NULL GROUP BY 1) SELECT n.route_id, n.need, min(s.capacity_total) AS capacity_total, arg_min(s.vehicle_type, s.capacity_total) AS vehicle_type FROM need n LEFT JOIN s ON s.capacity_total >= n.need GROUP BY ALL")
def join_theta_smallest_fit(passenger_counts, vehicles):
    need = passenger_counts.where("max_load between 0 and 400").groupBy("route_id").agg(F.max("max_load").alias("need"))
    return J.smallest_fit(need, "need", vehicles, "capacity_total", "vehicle_type")


@query("SELECT t.ticket_id, a.zone AS entry_zone, b.zone AS exit_zone FROM (SELECT DISTINCT ticket_id, entry_stop_id, exit_stop_id FROM tickets) t JOIN stops a ON t.entry_stop_id = a.stop_id JOIN stops b ON t.exit_stop_id = b.stop_id WHERE a.zone <> b.zone")
def join_role_dims(tickets, stops):
    t = tickets.select("ticket_id", "entry_stop_id", "exit_stop_id").distinct()
    a = stops.select(F.col("stop_id").alias("entry_stop_id"), F.col("zone").alias("entry_zone"))
    b = stops.select(F.col("stop_id").alias("exit_stop_id"), F.col("zone").alias("exit_zone"))
    return t.join(a, "entry_stop_id").join(b, "exit_stop_id").where("entry_zone != exit_zone").select("ticket_id", "entry_zone", "exit_zone")


@query("SELECT vehicle_id, min(depot) AS depot FROM vehicles WHERE vehicle_id IS NOT NULL AND depot IS NOT NULL GROUP BY 1 HAVING count(DISTINCT depot) = 1")
def join_unambiguous_lookup(vehicles):
    return J.unambiguous_lookup(vehicles, "vehicle_id", "depot")


@query("SELECT p.vehicle_id, p.event_time, p.latitude, p.longitude, p.event_id FROM gps_events p WHERE vehicle_id <> '' QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY event_time DESC, event_id DESC) = 1")
def join_latest_row(gps_events):
    rows = gps_events.where("vehicle_id != ''").select("vehicle_id", "event_time", "latitude", "longitude", "event_id")
    return J.latest_rows(rows, ["vehicle_id"], "event_time", "event_id")


@query("WITH f AS (SELECT zone, service_date, count(*) AS n FROM (SELECT DISTINCT * FROM tickets) t JOIN stops s ON t.entry_stop_id = s.stop_id WHERE zone IS NOT NULL GROUP BY ALL), d AS (SELECT unnest(generate_series(min(service_date), max(service_date), INTERVAL 1 DAY))::DATE AS service_date FROM f), c AS (SELECT DISTINCT zone FROM f) SELECT c.zone, d.service_date, coalesce(f.n, 0) AS n FROM c CROSS JOIN d LEFT JOIN f ON f.zone = c.zone AND f.service_date = d.service_date")
def join_dense_grid(tickets, stops):
    f = tickets.distinct().join(stops, tickets.entry_stop_id == stops.stop_id).where("zone is not null").groupBy("zone", "service_date").agg(F.count(F.lit(1)).alias("n"))
    return J.dense_grid(f, ["zone"], "service_date", ["n"])


@query("SELECT route_id, direction, service_date, count(*) AS trips, bool_or(d.trip_id IS NOT NULL) AS any_delay FROM (SELECT DISTINCT * FROM trips) t LEFT JOIN (SELECT DISTINCT trip_id FROM delays WHERE delay_minutes > 5) d USING (trip_id) GROUP BY ALL")
def join_existence_flag(trips, delays):
    late = delays.where("delay_minutes > 5").select("trip_id", F.lit(True).alias("late")).distinct()
    return trips.distinct().join(late, "trip_id", "left").groupBy("route_id", "direction", "service_date").agg(F.count(F.lit(1)).alias("trips"), F.coalesce(F.max("late"), F.lit(False)).alias("any_delay"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0 AND o_totalprice IS NOT NULL")
def join_reconcile(orders):
    stored = orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    fresh = stored.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return J.mismatches(stored, fresh, ["o_orderkey"], ["o_totalprice", "o_orderstatus"])


# ---- aggregates


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS quantity, round(avg(l_discount), 6) AS discount, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY ALL")
def agg_basic(lineitem):
    return lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"), r6(F.avg("l_discount")).alias("discount"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))


@query("SELECT count(*) AS n, count(DISTINCT vehicle_id) AS vehicles, count(DISTINCT trip_id) AS trips, min(event_time) AS first_time, max(speed_kmh) AS top_speed FROM gps_events")
def agg_global(gps_events):
    return gps_events.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vehicle_id").alias("vehicles"), F.countDistinct("trip_id").alias("trips"), F.min("event_time").alias("first_time"), F.max("speed_kmh").alias("top_speed"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY ALL")
def agg_distinct(events):
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.countDistinct(F.to_date("ts")).alias("days"))


@query("SELECT route_id, count(*) AS trips, count(*) FILTER (WHERE trip_status = 'cancelled') AS cancelled, count(*) FILTER (WHERE direction = 0) AS outward FROM (SELECT DISTINCT * FROM trips) GROUP BY ALL")
def agg_conditional(trips):
    return trips.distinct().groupBy("route_id").agg(F.count(F.lit(1)).alias("trips"), F.count(F.when(F.col("trip_status") == "cancelled", 1)).alias("cancelled"), F.count(F.when(F.col("direction") == 0, 1)).alias("outward"))


@query("SELECT vehicle_id, round(avg(CASE WHEN speed_kmh > 40 THEN 1e0 WHEN speed_kmh IS NOT NULL THEN 0e0 END), 6) AS fast FROM gps_events GROUP BY ALL")
def agg_null_share(gps_events):
    return gps_events.groupBy("vehicle_id").agg(r6(E.share(F.col("speed_kmh") > 40, F.col("speed_kmh"))).alias("fast"))


@query("SELECT p_brand, round(stddev(p_retailprice), 4) AS spread, round(stddev(p_retailprice) / nullif(avg(p_retailprice), 0), 6) AS cv FROM part GROUP BY ALL")
def agg_cv(part):
    return part.groupBy("p_brand").agg(F.round(F.stddev("p_retailprice"), 4).alias("spread"), r6(E.ratio(F.stddev("p_retailprice"), F.avg("p_retailprice"))).alias("cv"))


@query("SELECT l_returnflag, quantile_disc(l_extendedprice, 0.1) AS p10, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.9) AS p90 FROM lineitem GROUP BY ALL")
def agg_percentiles(lineitem):
    return R.exact_quantiles(lineitem, ["l_returnflag"], "l_extendedprice", (0.1, 0.5, 0.9)).withColumnsRenamed({"q0": "p10", "q1": "p50", "q2": "p90"})


@query()
def agg_approximate(gps_events):
    return gps_events.groupBy("event_type").agg(F.percentile_approx("speed_kmh", [0.1, 0.5, 0.9], 1000).alias("quantiles"), F.approx_count_distinct("trip_id", 0.02).alias("trips"))


@query("WITH c AS (SELECT stop_id, delay_reason, count(*) AS n FROM delays WHERE delay_reason IS NOT NULL GROUP BY ALL) SELECT stop_id, arg_min(delay_reason, (-n, delay_reason)) AS main_reason, max(n) AS main_reason_n FROM c GROUP BY 1")
def agg_mode(delays):
    return A.most_frequent(delays, ["stop_id"], "delay_reason", "main_reason")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest FROM orders GROUP BY ALL")
def agg_minmax_by(orders):
    by = F.struct("o_totalprice", "o_orderkey")
    return orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", by).alias("dearest"), F.min_by("o_orderkey", by).alias("cheapest"))


@query("SELECT route_id, coalesce(string_agg(DISTINCT trip_type, ',' ORDER BY trip_type), '') AS types FROM trips GROUP BY ALL")
def agg_collect(trips):
    return trips.groupBy("route_id").agg(F.array_join(F.array_sort(F.collect_set("trip_type")), ",").alias("types"))


@query("WITH d AS (SELECT route_id, service_date, sum(boardings) AS b FROM (SELECT DISTINCT * FROM passenger_counts) GROUP BY ALL) SELECT route_id, count(*) AS days, quantile_disc(b, 0.5)::BIGINT AS median_day FROM d GROUP BY ALL")
def agg_two_level_median(passenger_counts):
    d = passenger_counts.distinct().groupBy("route_id", "service_date").agg(F.sum("boardings").alias("b"))
    return d.groupBy("route_id").agg(F.count(F.lit(1)).alias("days"), A.exact_percentile("b", 0.5).cast("long").alias("median_day"))


@query("WITH c AS (SELECT route_id, direction, count(boardings) AS n, avg(boardings) AS m FROM (SELECT p.boardings, t.route_id, t.direction FROM (SELECT DISTINCT * FROM passenger_counts) p JOIN (SELECT DISTINCT trip_id, route_id, direction FROM trips) t USING (trip_id)) GROUP BY ALL) SELECT route_id, round(sum(n * m) / nullif(sum(n), 0), 6) AS mean_boardings FROM c GROUP BY ALL")
def agg_weighted_mean(passenger_counts, trips):
    j = passenger_counts.distinct().drop("route_id").join(trips.select("trip_id", "route_id", "direction").distinct(), "trip_id")
    c = j.groupBy("route_id", "direction").agg(F.count("boardings").alias("n"), F.avg("boardings").alias("m"))
    return c.groupBy("route_id").agg(r6(E.ratio(F.sum(F.col("n") * F.col("m")), F.sum("n"))).alias("mean_boardings"))


@query("SELECT vehicle_id, round(avg(speed_kmh) FILTER (WHERE event_type = 'ping'), 6) AS ping, round(avg(speed_kmh) FILTER (WHERE event_type = 'depart'), 6) AS depart, round(avg(speed_kmh) FILTER (WHERE event_type = 'dwell'), 6) AS dwell FROM gps_events GROUP BY ALL")
def agg_pivot(gps_events):
    p = A.pivot_means(gps_events, ["vehicle_id"], "event_type", ["ping", "depart", "dwell"], "speed_kmh")
    return p.select("vehicle_id", *[r6(F.col(c)).alias(c) for c in ("ping", "depart", "dwell")])


@query("SELECT dimension, value, count(*) AS n, round(sum(price), 2) AS price FROM (SELECT l_extendedprice AS price, unnest([{'dimension': 'flag', 'value': l_returnflag}, {'dimension': 'status', 'value': l_linestatus}, {'dimension': 'line', 'value': CAST(l_linenumber AS VARCHAR)}], recursive := true) FROM lineitem) GROUP BY ALL")
def agg_unpivot_dimension(lineitem):
    dims = {"flag": F.col("l_returnflag"), "status": F.col("l_linestatus"), "line": F.col("l_linenumber")}
    return A.by_dimensions(lineitem, dims, [F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price")])


@query("WITH c AS (SELECT route_id, entry_stop_id, count(*) AS taps, count(DISTINCT passenger_id) AS people FROM tickets GROUP BY ALL), r AS (SELECT route_id, sum(taps) AS t, sum(people) AS p FROM c GROUP BY 1), a AS (SELECT sum(taps) AS t, sum(people) AS p FROM c) SELECT c.*, round(CASE WHEN people >= 30 THEN taps / people WHEN r.p >= 30 THEN r.t / r.p ELSE a.t / a.p END, 6) AS factor, CASE WHEN people >= 30 THEN 'cell' WHEN r.p >= 30 THEN 'route' ELSE 'all' END AS factor_level FROM c JOIN r ON c.route_id = r.route_id, a")
def agg_fallback_factor(tickets):
    c = tickets.groupBy("route_id", "entry_stop_id").agg(F.count(F.lit(1)).alias("taps"), F.countDistinct("passenger_id").alias("people"))
    f = A.factor_with_fallback(c, [["route_id", "entry_stop_id"], ["route_id"], []], "taps", "people", 30, ["cell", "route", "all"])
    return f.withColumn("factor", r6(F.col("factor")))


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies, count(DISTINCT (l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)) AS versions FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def agg_duplicate_groups(lineitem):
    return A.duplicate_groups(lineitem, ["l_orderkey", "l_linenumber"])


@query("SELECT n_name, c_mktsegment, count(*) AS n, GROUPING(n_name)::INT AS g_nation, GROUPING(c_mktsegment)::INT AS g_segment FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)")
def agg_rollup(customer, nation):
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).rollup("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.grouping("n_name").cast("int").alias("g_nation"), F.grouping("c_mktsegment").cast("int").alias("g_segment"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(lineitem):
    return lineitem.cube("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def agg_grouping_sets(orders):
    return orders.groupingSets([[F.col("o_orderstatus")], [F.col("o_orderpriority")], []], "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query()
def agg_fingerprint(lineitem):
    return A.fingerprint(lineitem)


def _profile_sql(c: str, numeric: bool) -> str:
    x = f"CAST({c} AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)"
    bound = f"CAST({{}}(CAST({c} AS DOUBLE)) AS VARCHAR)" if numeric else f"{{}}({c})"
    quartiles = ", ".join(f"round(quantile_cont({x}, {p}), 6) AS q{round(p * 100)}" for p in (0.25, 0.5, 0.75))
    tops = f"(SELECT string_agg(v || ':' || n, ', ' ORDER BY n DESC, v) FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM passenger_counts WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 5))"
    return f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(DISTINCT {c}) AS distinct_values, {bound.format('min')} AS least, {bound.format('max')} AS most, round(avg({x}), 6) AS mean, round(stddev({x}), 4) AS std, {quartiles}, {tops} AS top_values FROM passenger_counts"


@query(" UNION ALL ".join(_profile_sql(c, n) for c, n in (("vehicle_id", False), ("boardings", True), ("max_load", True))))
def agg_profile(passenger_counts):
    p = A.column_profile(passenger_counts, ["vehicle_id", "boardings", "max_load"])
    return p.select("column", "rows", "nulls", "distinct_values", F.col("min").alias("least"), F.col("max").alias("most"), r6(F.col("mean")).alias("mean"), F.round("std", 4).alias("std"), *[r6(F.col(q)).alias(q) for q in ("q25", "q50", "q75")], "top_values")


@query("WITH c AS (SELECT record_source AS l, CASE WHEN delay_minutes > 3 THEN 'avl' ELSE 'manual' END AS p FROM delays WHERE record_source IS NOT NULL), k AS (SELECT l AS class FROM c UNION SELECT p FROM c) SELECT class, count(*) FILTER (WHERE l = class) AS support, round(count(*) FILTER (WHERE l = class AND p = class) / nullif(count(*) FILTER (WHERE p = class), 0), 6) AS precision, round(count(*) FILTER (WHERE l = class AND p = class) / nullif(count(*) FILTER (WHERE l = class), 0), 6) AS recall, round(2 * count(*) FILTER (WHERE l = class AND p = class) / (count(*) FILTER (WHERE l = class) + count(*) FILTER (WHERE p = class)), 6) AS f1 FROM c JOIN k ON l = class OR p = class GROUP BY 1")
def agg_confusion(delays):
    rows = delays.where("record_source is not null").select(F.col("record_source").alias("l"), F.when(F.col("delay_minutes") > 3, "avl").otherwise("manual").alias("p"))
    c = A.classification_report(rows, "l", "p")
    return c.select("class", F.col("support").cast("long").alias("support"), *[r6(F.col(x)).alias(x) for x in ("precision", "recall", "f1")])


@query("SELECT route_id, count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END), 6) AS mape, round(1 - sum((y - p) ** 2) / nullif(var_pop(y) * count(*), 0), 6) AS r2 FROM (SELECT route_id, boardings::DOUBLE AS y, alightings::DOUBLE AS p FROM passenger_counts) WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY ALL")
def agg_regression(passenger_counts):
    r = A.regression_report(passenger_counts, "boardings", "alightings", ["route_id"])
    return r.select("route_id", "n", *[r6(F.col(x)).alias(x) for x in ("mae", "rmse", "mape", "r2")])


# ---- windows


@query("WITH a AS (SELECT c_mktsegment, o_orderpriority, round(avg(o_totalprice), 4) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT *, CAST(dense_rank() OVER (ORDER BY m DESC) AS INT) AS overall, CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY m DESC NULLS LAST) AS INT) AS in_segment FROM a")
def win_ranks(orders, customer):
    from pyspark.sql import Window

    a = orders.join(customer, orders.o_custkey == customer.c_custkey).groupBy("c_mktsegment", "o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("m"))
    return a.withColumns({"overall": F.dense_rank().over(Window.orderBy(F.desc("m"))), "in_segment": F.rank().over(Window.partitionBy("c_mktsegment").orderBy(F.desc_nulls_last("m")))})


@query("SELECT s_suppkey, s_nationkey, round(100 * percent_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal NULLS FIRST), 6) AS score FROM supplier")
def win_percent_rank_score(supplier):
    from pyspark.sql import Window

    return supplier.select("s_suppkey", "s_nationkey", r6(100 * F.percent_rank().over(Window.partitionBy("s_nationkey").orderBy(F.asc_nulls_first("s_acctbal")))).alias("score"))


@query("SELECT * FROM delays QUALIFY row_number() OVER (PARTITION BY delay_id ORDER BY scheduled_arrival NULLS FIRST) = 1")
def win_row_number_dedup(delays):
    return W.top_per_group(delays, ["delay_id"], [F.asc_nulls_first("scheduled_arrival")])


@query("WITH t AS (SELECT DISTINCT * FROM trips), p AS (SELECT trip_id, scheduled_departure AS d, last_value(CASE WHEN trip_status <> 'cancelled' THEN scheduled_departure END IGNORE NULLS) OVER (PARTITION BY route_id, direction ORDER BY scheduled_departure, trip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t) SELECT trip_id, round((epoch_us(d) - epoch_us(before)) / 6e7, 6) AS gap_min FROM p")
def win_prior_last_gap(trips):
    p = W.previous_kept(trips.distinct(), ["route_id", "direction"], ["scheduled_departure", "trip_id"], "scheduled_departure", F.col("trip_status") != "cancelled", "before")
    return p.select("trip_id", r6(E.minutes_between(F.col("before"), F.col("scheduled_departure"))).alias("gap_min"))


@query("SELECT user_id, event_id, value, lag(value) OVER w AS value_lag_1, lag(value, 7) OVER w AS value_lag_7 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win_lags(events):
    return W.lags(events, ["user_id"], ["ts", "event_id"], "value", (1, 7)).select("user_id", "event_id", "value", "value_lag_1", "value_lag_7")


@query("WITH k AS (SELECT DISTINCT event_id, vehicle_id, event_time, stop_id FROM gps_events WHERE vehicle_id <> '' AND stop_id IS NOT NULL AND event_time IS NOT NULL), l AS (SELECT *, lag(event_time) OVER w AS t0, lag(stop_id) OVER w AS s0 FROM k WINDOW w AS (PARTITION BY vehicle_id ORDER BY event_time, event_id)) SELECT event_id, vehicle_id FROM l WHERE epoch_us(event_time) - epoch_us(t0) <= 120000000 AND stop_id = s0")
def win_lag_repeat(gps_events):
    """A vehicle's events at the stop of its event before, at most two minutes later."""
    k = gps_events.where("vehicle_id != '' and stop_id is not null and event_time is not null").select("event_id", "vehicle_id", "event_time", "stop_id").distinct()
    at = k.withColumn("at", F.unix_micros(F.col("event_time").cast("timestamp")))
    lagged = W.lags(W.lags(at, ["vehicle_id"], ["event_time", "event_id"], "at", (1,)), ["vehicle_id"], ["event_time", "event_id"], "stop_id", (1,))
    return lagged.where("at - at_lag_1 <= 120000000 and stop_id = stop_id_lag_1").select("event_id", "vehicle_id")


@query("WITH e AS (SELECT trip_id, entry_time AS t, ticket_id, 1 AS n FROM (SELECT DISTINCT * FROM tickets) WHERE trip_id <> '' AND entry_time IS NOT NULL UNION ALL SELECT trip_id, exit_time, ticket_id, -1 FROM (SELECT DISTINCT * FROM tickets) WHERE trip_id <> '' AND exit_time IS NOT NULL) SELECT trip_id, t, ticket_id, n, CAST(sum(n) OVER (PARTITION BY trip_id ORDER BY t, n DESC, ticket_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS on_board FROM e")
def win_running_load(tickets):
    k = tickets.distinct().where("trip_id != ''")
    e = k.where("entry_time is not null").select("trip_id", F.col("entry_time").alias("t"), "ticket_id", F.lit(1).alias("n")).unionByName(k.where("exit_time is not null").select("trip_id", F.col("exit_time").alias("t"), "ticket_id", F.lit(-1).alias("n")))
    return W.running_total(e, ["trip_id"], ["t", F.desc("n"), "ticket_id"], F.col("n"), "on_board")


@query("WITH s AS (SELECT DISTINCT schedule_id, route_id, service_id, direction, period, valid_from, coalesce(valid_to, DATE '9999-12-31') AS valid_to FROM schedules), o AS (SELECT *, max(valid_to) OVER (PARTITION BY route_id, service_id, direction, period ORDER BY valid_from, valid_to, schedule_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s) SELECT period, count(*) AS n, count(*) FILTER (WHERE valid_from < reach) AS overlapping FROM o GROUP BY ALL")
def win_overlap_intervals(schedules):
    s = schedules.select("schedule_id", "route_id", "service_id", "direction", "period", "valid_from", F.coalesce("valid_to", F.lit("9999-12-31").cast("date")).alias("valid_to")).distinct()
    o = W.overlaps_earlier(s, ["route_id", "service_id", "direction", "period"], "valid_from", "valid_to", "hit")
    return o.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("hit"), 1)).alias("overlapping"))


def _daily(route_daily_boardings: DataFrame) -> DataFrame:
    from fareline.operators.rolling import daily_values

    d = daily_values(route_daily_boardings, "route_id", "service_date", "boardings", "loaded_at")
    return d.select(F.col("entity").alias("route_id"), F.col("day").alias("service_date"), F.unix_date("day").alias("d"), F.dayofweek("day").alias("dow"), F.col("value").cast("double").alias("b"))


_DAILY = "WITH r AS (SELECT route_id, service_date, CAST(date_diff('day', DATE '1970-01-01', service_date) AS INT) AS d, dayofweek(service_date) + 1 AS dow, arg_max_null(boardings, (loaded_at, boardings))::DOUBLE AS b FROM route_daily_boardings WHERE route_id <> '' GROUP BY ALL)"


@query(_DAILY + " SELECT route_id, service_date, round(CASE WHEN avg(b) OVER p > 0 THEN avg(b) OVER n / avg(b) OVER p - 1 END, 6) AS growth FROM r WINDOW n AS (PARTITION BY route_id ORDER BY d RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING), p AS (PARTITION BY route_id ORDER BY d RANGE BETWEEN 14 PRECEDING AND 8 PRECEDING)")
def win_range_growth(route_daily_boardings):
    return W.growth(_daily(route_daily_boardings), ["route_id"], "d", "b", 7, "growth").select("route_id", "service_date", r6(F.col("growth")).alias("growth"))


@query(_DAILY + ", h AS (SELECT *, list_sort(list(b) FILTER (WHERE b IS NOT NULL) OVER (PARTITION BY route_id, dow ORDER BY d RANGE BETWEEN 56 PRECEDING AND 7 PRECEDING)) AS h FROM r) SELECT route_id, service_date, b, coalesce(len(h), 0)::INT AS usual_n, CASE WHEN len(h) >= 4 THEN (h[(len(h) + 1) // 2] + h[len(h) // 2 + 1]) / 2 END AS usual FROM h")
def win_range_median_anomaly(route_daily_boardings):
    return W.history_median(_daily(route_daily_boardings), ["route_id", "dow"], "d", "b", -56, -7, "usual", least=4).select("route_id", "service_date", "b", "usual_n", "usual")


@query(_DAILY + " SELECT route_id, service_date, round(avg(b) OVER (PARTITION BY route_id ORDER BY d ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING), 6) AS last_28 FROM r")
def win_rows_rolling(route_daily_boardings):
    return W.rolling_rows(_daily(route_daily_boardings), ["route_id"], ["d"], "b", 28, "last_28").select("route_id", "service_date", r6(F.col("last_28")).alias("last_28"))


@query(_DAILY + " SELECT route_id, service_date, round(avg(b) OVER (PARTITION BY route_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS so_far FROM r")
def win_prior_expanding(route_daily_boardings):
    return W.prior_mean(_daily(route_daily_boardings), ["route_id"], ["d"], "b", "so_far").select("route_id", "service_date", r6(F.col("so_far")).alias("so_far"))


@query("WITH a AS (SELECT zone, stop_type, count(*) AS n FROM stops GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY zone), 6) AS part FROM a")
def win_share_of_total(stops):
    a = stops.groupBy("zone", "stop_type").agg(F.count(F.lit(1)).alias("n"))
    return W.share_of_total(a, ["zone"], "n", "part").withColumn("part", r6(F.col("part")))


@query("WITH a AS (SELECT user_id, CAST(hour(ts) AS INT) AS h, count(*) AS n FROM events GROUP BY ALL) SELECT *, round((n - avg(n) OVER (PARTITION BY user_id)) / nullif(stddev(n) OVER (PARTITION BY user_id), 0), 6) AS z FROM a")
def win_zscore(events):
    a = events.groupBy("user_id", F.hour("ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return W.zscore(a, ["user_id"], "n", "z").withColumn("z", r6(F.col("z")))


@query("SELECT p_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS part FROM part GROUP BY ALL")
def win_agg_share(part):
    a = part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    return W.share_of_total(a, [], "n", "part").withColumn("part", r6(F.col("part")))


@query("WITH g AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS began FROM s GROUP BY ALL")
def win_sessions(events):
    return W.sessions(events, ["user_id"], "ts", ["event_id"], 1800).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("began"))


# ---- sorts, limits, set operations


@query("SELECT DISTINCT delay_id, delay_minutes FROM delays WHERE delay_minutes IS NOT NULL ORDER BY delay_minutes DESC, delay_id LIMIT 500")
def topk_deterministic(delays):
    return delays.where("delay_minutes is not null").select("delay_id", "delay_minutes").distinct().orderBy(F.desc("delay_minutes"), "delay_id").limit(500)


_ROUTES = View(equal=("route_type", "status"), either={"stop": ("origin_stop_id", "destination_stop_id")}, search=("route_name", "route_code"), sortable=("distance_km", "route_id"), tiebreak=("route_id",), day="launch_date")


@query("SELECT route_id, distance_km FROM routes WHERE launch_date >= DATE '2012-01-01' AND (lower(route_name) LIKE '%a%' OR lower(route_code) LIKE '%a%') ORDER BY distance_km DESC NULLS LAST, route_id NULLS LAST LIMIT 5 OFFSET 2")
def page_offset(routes):
    found = filtered(routes, _ROUTES, {"from": "2012-01-01", "q": "a"})
    return ordered(found, _ROUTES, "-distance_km").offset(2).limit(5).select("route_id", "distance_km")


@query("SELECT 'negative_fare' AS kind, ticket_id AS entity, fare_amount AS observed FROM tickets WHERE fare_amount < 0 UNION ALL SELECT 'negative_boardings', count_id, boardings::DOUBLE FROM passenger_counts WHERE boardings < 0 UNION ALL SELECT 'speeding', event_id, speed_kmh FROM gps_events WHERE speed_kmh > 120")
def set_union_all_signals(tickets, passenger_counts, gps_events):
    def signal(df: DataFrame, kind: str, entity: str, value: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(entity).alias("entity"), F.col(value).cast("double").alias("observed"))

    return A.union_all([signal(tickets.where("fare_amount < 0"), "negative_fare", "ticket_id", "fare_amount"), signal(passenger_counts.where("boardings < 0"), "negative_boardings", "count_id", "boardings"), signal(gps_events.where("speed_kmh > 120"), "speeding", "event_id", "speed_kmh")])


@query("SELECT vehicle_id FROM trips INTERSECT SELECT vehicle_id FROM vehicles")
def set_intersect(trips, vehicles):
    return trips.select("vehicle_id").intersect(vehicles.select("vehicle_id"))


@query("SELECT entry_stop_id AS stop_id FROM tickets EXCEPT SELECT stop_id FROM stops")
def set_except(tickets, stops):
    return tickets.select(F.col("entry_stop_id").alias("stop_id")).subtract(stops.select("stop_id"))


@query("WITH a AS (SELECT entry_stop_id AS s, count(*) AS n FROM tickets GROUP BY 1), b AS (SELECT exit_stop_id AS s, count(*) AS n FROM tickets GROUP BY 1), j AS (SELECT coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b FROM a FULL JOIN b ON a.s = b.s) SELECT sum(n_a)::BIGINT AS n_a, sum(n_b)::BIGINT AS n_b, sum(least(n_a, n_b))::BIGINT AS n_both FROM j")
def set_multiset_overlap(tickets):
    return A.multiset_overlap(tickets.select(F.col("entry_stop_id").alias("s")), tickets.select(F.col("exit_stop_id").alias("s")), ["s"])


# ---- data quality

_KEYS = {"trips": ["trip_id"], "tickets": ["ticket_id"], "passenger_counts": ["count_id"], "delays": ["delay_id"], "gps_events": ["event_id"], "stops": ["stop_id"], "routes": ["route_id"], "schedules": ["schedule_id"], "vehicles": ["version_id"], "lineitem": ["l_orderkey", "l_linenumber"], "orders": ["o_orderkey"]}

RULES = {
    r.check: r
    for r in (
        Q.Rule("R01", "required_value", "delays", params={"column": "route_id"}),
        Q.Rule("R02", "foreign_key", "passenger_counts", params={"columns": ["vehicle_id"], "parent_table": "vehicles", "parent_key": "vehicle_id"}),
        Q.Rule("R03", "duplicate_key", "tickets"),
        Q.Rule("R04", "non_negative", "passenger_counts", params={"columns": ["boardings", "alightings"]}),
        Q.Rule("R06", "time_gap", "delays", params={"column": "actual_arrival", "reference": "scheduled_arrival", "hours": 6}),
        Q.Rule("R07", "time_order", "delays", params={"earlier": "actual_arrival", "later": "actual_departure"}),
        Q.Rule("R08", "capacity", "passenger_counts", params={"load_column": "max_load", "carrier_column": "vehicle_id", "carrier_table": "vehicles", "carrier_key": "vehicle_id", "capacity_column": "capacity_total", "factor": 1.5}),
        Q.Rule("R09", "value_range", "routes", params={"column": "distance_km", "low": 0, "high": 200, "low_exclusive": True}),
        Q.Rule("R10", "sequence_integrity", "lineitem", params={"group_by": ["l_orderkey"], "sequence_column": "l_linenumber"}),
        Q.Rule("R11", "missing_parent", "trips", params={"parent_key": "trip_id", "child_tables": ["tickets", "passenger_counts", "delays"], "child_column": "trip_id"}),
        Q.Rule("R12", "timestamp_date_window", "tickets", params={"column": "received_at", "date_column": "service_date", "low_days": 0, "high_days": 2}),
        Q.Rule("R13", "geo_bounds", "stops", params={"lat": "latitude", "lon": "longitude", "box": [11.9, 12.6, 33.0, 33.8]}),
        Q.Rule("R14", "count_vs_children", "passenger_counts", params={"count_column": "card_taps", "child_table": "tickets", "child_key": "ticket_id", "join_column": "trip_id"}),
        Q.Rule("R15", "overlapping_intervals", "schedules", params={"group_by": ["route_id", "service_id", "direction", "period"], "start": "valid_from", "end": "valid_to"}),
    )
}


class _Tables(dict):
    """The tables with known keys, opened when they are first wanted."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.open = lambda name: table(spark, sf_dir, name)

    def __contains__(self, name: object) -> bool:
        return name in _KEYS

    def __missing__(self, name: str) -> DataFrame:
        if name not in _KEYS:
            raise KeyError(name)
        self[name] = self.open(name)
        return self[name]


def _catalog(spark: SparkSession, sf_dir: str) -> Q.Catalog:
    return Q.Catalog(_Tables(spark, sf_dir), _KEYS)


def _rule_query(rule: Q.Rule) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Q.run_rule(_catalog(spark, sf_dir), rule)

    return run


def _violation(rule: str, name: str, key: str, column: str, observed: str, units: str, source: str) -> str:
    return f"SELECT '{rule}' AS rule_id, '{name}' AS \"table\", {key} AS record_key, {column} AS \"column\", {observed} AS observed_value, CAST({units} AS BIGINT) AS units FROM {source}"


for _name, _rule in RULES.items():
    QUERIES[f"dq_{_name}"] = _rule_query(_rule)

_ts = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
SQL |= {
    "dq_required_value": _violation("R01", "delays", "delay_id", "'route_id'", "route_id", "1", "delays WHERE route_id IS NULL OR trim(route_id) = ''"),
    "dq_foreign_key": _violation("R02", "passenger_counts", "count_id", "'vehicle_id'", "vehicle_id", "1", "passenger_counts WHERE vehicle_id IS NOT NULL AND vehicle_id NOT IN (SELECT vehicle_id FROM vehicles)"),
    "dq_duplicate_key": _violation("R03", "tickets", "ticket_id", "'ticket_id'", "CASE WHEN v = 1 THEN 'identical' ELSE 'conflicting' END", "n - 1", "(SELECT ticket_id, count(*) AS n, count(DISTINCT t) AS v FROM tickets t GROUP BY ticket_id HAVING count(*) > 1)"),
    "dq_non_negative": _violation("R04", "passenger_counts", "count_id", "concat_ws(',', CASE WHEN boardings < 0 THEN 'boardings' END, CASE WHEN alightings < 0 THEN 'alightings' END)", "concat_ws(',', CASE WHEN boardings < 0 THEN boardings END, CASE WHEN alightings < 0 THEN alightings END)", "1", "passenger_counts WHERE boardings < 0 OR alightings < 0"),
    "dq_time_gap": _violation("R06", "delays", "delay_id", "'actual_arrival'", _ts.format("actual_arrival"), "1", "delays WHERE abs(epoch_us(actual_arrival) - epoch_us(scheduled_arrival)) > 6 * 3600000000"),
    "dq_time_order": _violation("R07", "delays", "delay_id", "'actual_departure'", _ts.format("actual_departure"), "1", "delays WHERE actual_departure < actual_arrival"),
    "dq_capacity": _violation("R08", "passenger_counts", "count_id", "'max_load'", "CAST(max_load AS VARCHAR)", "1", "passenger_counts JOIN (SELECT vehicle_id, max(capacity_total) AS size FROM vehicles GROUP BY 1) USING (vehicle_id) WHERE max_load > size * 1.5"),
    "dq_value_range": _violation("R09", "routes", "coalesce(route_id, '')", "'distance_km'", "CAST(distance_km AS VARCHAR)", "1", "routes WHERE distance_km <= 0 OR distance_km > 200"),
    "dq_sequence_integrity": _violation("R10", "lineitem", "CAST(l_orderkey AS VARCHAR)", "'l_linenumber'", "concat_ws('/', d, n, lo, hi)", "1", "(SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS d, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem GROUP BY 1) WHERE d < n OR lo <> 1 OR hi <> n"),
    "dq_missing_parent": _violation("R11", "trips", "p", "'trip_id'", "o", "1", "(SELECT p, string_agg(DISTINCT c, ',' ORDER BY c) AS o FROM (SELECT trip_id AS p, 'tickets' AS c FROM tickets UNION SELECT trip_id, 'passenger_counts' FROM passenger_counts UNION SELECT trip_id, 'delays' FROM delays) WHERE p IS NOT NULL AND p NOT IN (SELECT trip_id FROM trips) GROUP BY 1)"),
    "dq_timestamp_date_window": _violation("R12", "tickets", "ticket_id", "'received_at'", _ts.format("received_at"), "1", "tickets WHERE date_diff('day', service_date, CAST(received_at AS DATE)) NOT BETWEEN 0 AND 1"),
    "dq_geo_bounds": _violation("R13", "stops", "stop_id", "'latitude,longitude'", "concat_ws(',', latitude, longitude)", "1", "stops WHERE NOT (latitude BETWEEN 11.9 AND 12.6 AND longitude BETWEEN 33.0 AND 33.8)"),
    "dq_count_vs_children": _violation("R14", "passenger_counts", "count_id", "'card_taps'", "CAST(card_taps AS VARCHAR)", "card_taps - coalesce(n, 0)", "passenger_counts LEFT JOIN (SELECT trip_id, count(DISTINCT ticket_id) AS n FROM tickets GROUP BY 1) USING (trip_id) WHERE card_taps > coalesce(n, 0)"),
    "dq_overlapping_intervals": _violation("R15", "schedules", "schedule_id", "'valid_from'", "CAST(valid_from AS VARCHAR)", "1", "(SELECT *, max(valid_to) OVER (PARTITION BY route_id, service_id, direction, period ORDER BY valid_from NULLS FIRST, valid_to NULLS FIRST, schedule_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM schedules) WHERE valid_from < reach"),
}


# the rule of R15 where a null valid_to means no end, as the tables define it
OPEN_INTERVALS = Q.Rule("R15", "overlapping_intervals", "schedules", params=RULES["overlapping_intervals"].params | {"open_end": True})
QUERIES["dq_overlapping_intervals_open"] = _rule_query(OPEN_INTERVALS)
SQL["dq_overlapping_intervals_open"] = _violation("R15", "schedules", "schedule_id", "'valid_from'", "CAST(valid_from AS VARCHAR)", "1", "(SELECT *, max(coalesce(valid_to, DATE '9999-12-31')) OVER (PARTITION BY route_id, service_id, direction, period ORDER BY valid_from NULLS FIRST, valid_to NULLS LAST, schedule_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM schedules) WHERE valid_from < reach")


# the value tests of the lines, by table
_TESTED = {"delays": "delay_minutes", "tickets": "entry_time", "passenger_counts": "boardings"}
# places of the key and of trip_id in a line
_PLACES = {"delays": ("delay_id", 2), "tickets": ("ticket_id", 3), "passenger_counts": ("count_id", 2)}
UNPARSEABLE = [Q.Rule("R05", "unparseable", name, params={"columns": [column, "quoting", "columns"]}) for name, column in _TESTED.items()]


def _failed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, table_name, reason, raw_line) of the lines that fail, each once."""
    from fareline.plans.problems import parsed_records, split_failed

    failed = split_failed(parsed_records(spark, sf_dir)).select("record_id", "table_name", "reason").distinct()
    return stored(failed.join(table(spark, sf_dir, "raw_records").select("record_id", "raw_line").distinct(), "record_id"))  # read per table and rule


def _unparseable(spark: SparkSession, sf_dir: str, failed: DataFrame) -> DataFrame:
    lines = {
        name: failed.where(F.col("table_name") == name).select(F.col("record_id").cast("string").alias(_PLACES[name][0]), F.when(F.col("reason") == "value", column).otherwise(F.col("reason")).alias("failed_columns"), F.col("raw_line").alias("raw_record"))
        for name, column in _TESTED.items()
    }
    return Q.run_rules(Q.Catalog({n: table(spark, sf_dir, n) for n in lines}, _KEYS, lines), UNPARSEABLE)


def dq_unparseable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every failing line of raw_records as a violation of its table: the column is the one whose value fails,
    or 'quoting' or 'columns'; the key is the record_id, the observed value the whole line."""
    return _unparseable(spark, sf_dir, _failed_lines(spark, sf_dir))


def dq_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 15 checks. R11 and R14 also see quarantined children, as far as their fields are told apart (lines
    that fail by a value); R15 reads a null end as no end."""
    failed = _failed_lines(spark, sf_dir)

    def field(i: int) -> Column:
        f = F.get(F.regexp_extract_all(F.concat(F.lit(","), "raw_line"), F.lit(',("(?:[^"]|"")*"|[^",]*)'), F.lit(1)), F.lit(i - 1))
        return F.nullif(F.when(f.startswith('"'), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f), F.lit(""))

    children = {name: failed.where((F.col("table_name") == name) & (F.col("reason") == "value")).select(field(1).alias(key), field(trip).alias("trip_id")) for name, (key, trip) in _PLACES.items()}
    c = Q.Catalog(_catalog(spark, sf_dir).tables, _KEYS, children)
    rules = [r for name, r in RULES.items() if name != "overlapping_intervals"] + [OPEN_INTERVALS]
    return Q.violation_summary(Q.run_rules(c, rules).unionByName(_unparseable(spark, sf_dir, failed)))


QUERIES |= {"dq_unparseable": dq_unparseable, "dq_summary": dq_summary}


def _field_sql(i: int) -> str:
    return f"nullif(CASE WHEN fields[{i}] LIKE '\"%' THEN replace(substr(fields[{i}], 2, length(fields[{i}]) - 2), '\"\"', '\"') ELSE fields[{i}] END, '')"


def _children_sql(name: str, *places: int) -> str:
    return f"SELECT {', '.join(map(_field_sql, places))} FROM e WHERE table_name = '{name}' AND reason = 'value'"


_UNPARSEABLE_SQL = " UNION ALL ".join(_violation("R05", name, "CAST(record_id AS VARCHAR)", f"CASE reason WHEN 'value' THEN '{column}' ELSE reason END", "raw_line", "1", f"e JOIN (SELECT record_id, raw_line FROM r) USING (record_id) WHERE table_name = '{name}' AND reason IS NOT NULL") for name, column in _TESTED.items())
_MISSING_ALL = _violation("R11", "trips", "p", "'trip_id'", "o", "1", "(SELECT p, string_agg(DISTINCT c, ',' ORDER BY c) AS o FROM (" + " UNION ".join(f"SELECT trip_id AS p, '{n}' AS c FROM {n} UNION SELECT p, '{n}' FROM ({_children_sql(n, trip)}) AS q(p)" for n, (_, trip) in _PLACES.items()) + ") WHERE p IS NOT NULL AND p NOT IN (SELECT trip_id FROM trips WHERE trip_id IS NOT NULL) GROUP BY 1)")
_CHILDREN_ALL = _violation("R14", "passenger_counts", "count_id", "'card_taps'", "CAST(card_taps AS VARCHAR)", "card_taps - coalesce(n, 0)", f"passenger_counts LEFT JOIN (SELECT trip_id, count(DISTINCT ticket_id) AS n FROM (SELECT trip_id, ticket_id FROM tickets UNION ALL {_children_sql('tickets', 3, 1)}) GROUP BY 1) USING (trip_id) WHERE card_taps > coalesce(n, 0)")
_SUMMARY_ALL = {n: SQL[f"dq_{n}"] for n in RULES} | {"missing_parent": _MISSING_ALL, "count_vs_children": _CHILDREN_ALL, "overlapping_intervals": SQL["dq_overlapping_intervals_open"], "unparseable": _UNPARSEABLE_SQL}
SQL["dq_unparseable"] = _LINES + _UNPARSEABLE_SQL
SQL["dq_summary"] = _LINES + "SELECT rule_id, \"table\", count(*) AS records, sum(units)::BIGINT AS units FROM (" + " UNION ALL ".join(_SUMMARY_ALL.values()) + ") GROUP BY ALL"

_CLEAN_RULES = [
    Q.Rule("C1", "value_range", "delays", action="correct", params={"column": "delay_minutes", "low": -60, "high": 600}),
    Q.Rule("C2", "required_value", "delays", action="correct", params={"column": "route_id"}),
    Q.Rule("C3", "time_order", "delays", action="flag", params={"earlier": "actual_arrival", "later": "actual_departure"}),
    Q.Rule("C4", "time_gap", "delays", action="quarantine", params={"column": "actual_arrival", "reference": "scheduled_arrival", "hours": 12}),
]


def _cleaned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, C.Correction], DataFrame, DataFrame]:
    """The cleaned rows, the corrections, the removed copies and the rows whose copies conflict."""
    delays = table(spark, sf_dir, "delays")
    kept, removed, conflicting = C.split_duplicates(delays, ["delay_id"])
    c = Q.Catalog({"delays": kept}, _KEYS)
    fixes = {"C1": C.from_minutes("delay_minutes", "scheduled_arrival", "actual_arrival", -60, 600), "C2": C.from_lookup("route_id", "trip_id", table(spark, sf_dir, "trips").where("route_id != ''"), "route_id")}
    return C.clean(c, "delays", _CLEAN_RULES, Q.run_rules(c, _CLEAN_RULES), fixes), fixes, removed, conflicting


_CLEAN_SQL = """
WITH c AS (SELECT delay_id FROM (SELECT DISTINCT * FROM delays) GROUP BY 1 HAVING count(*) > 1), k AS (SELECT DISTINCT * FROM delays ANTI JOIN c USING (delay_id)), l AS (SELECT trip_id, min(route_id) AS r FROM trips WHERE route_id <> '' AND trip_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT route_id) = 1),
h AS (SELECT k.*, l.r, coalesce(delay_minutes NOT BETWEEN -60 AND 600, false) AS h1, route_id IS NULL OR trim(route_id) = '' AS h2, coalesce(actual_departure < actual_arrival, false) AS h3,
  coalesce(abs(epoch_us(actual_arrival) - epoch_us(scheduled_arrival)) > 12 * 3600000000, false) AS h4, round((epoch_us(actual_arrival) - epoch_us(scheduled_arrival)) / 6e7, 1) AS m FROM k LEFT JOIN l USING (trip_id)),
f AS (SELECT *, h1 AND coalesce(m BETWEEN -60 AND 600, false) AS f1, h2 AND r IS NOT NULL AS f2 FROM h),
s AS (SELECT *, CASE WHEN h4 THEN 'quarantined' WHEN h3 OR (h1 AND NOT f1) OR (h2 AND NOT f2) THEN 'flagged' WHEN f1 OR f2 THEN 'corrected' ELSE 'clean' END AS dq_status FROM f)
"""


def clean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir)[0].select("delay_id", "route_id", F.round("delay_minutes", 3).alias("delay_minutes"), "dq_status")


def clean_audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned, fixes, _, _ = _cleaned(spark, sf_dir)
    return C.audit_log(cleaned, "delays", _CLEAN_RULES, fixes).groupBy("rule_id", "action", "final_status").agg(F.count(F.lit(1)).alias("n"))


def clean_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned, _, removed, conflicting = _cleaned(spark, sf_dir)
    held_back = cleaned.where("dq_status = 'quarantined'").select("delay_id").unionByName(conflicting.select("delay_id"))
    return C.reconcile(table(spark, sf_dir, "delays"), cleaned.where("dq_status != 'quarantined'"), removed, held_back)


QUERIES |= {"clean_rows": clean_rows, "clean_audit_log": clean_audit_log, "clean_reconcile": clean_reconcile}
SQL |= {
    "clean_rows": _CLEAN_SQL + "SELECT delay_id, CASE WHEN f2 THEN r ELSE route_id END AS route_id, round(CASE WHEN f1 THEN m ELSE delay_minutes END, 3) AS delay_minutes, dq_status FROM s",
    "clean_audit_log": _CLEAN_SQL + ", g AS (SELECT 'C1' AS rule_id, CASE WHEN f1 THEN 'correct' ELSE 'flag' END AS action, dq_status FROM s WHERE h1 UNION ALL SELECT 'C2', CASE WHEN f2 THEN 'correct' ELSE 'flag' END, dq_status FROM s WHERE h2 UNION ALL SELECT 'C3', 'flag', dq_status FROM s WHERE h3 UNION ALL SELECT 'C4', 'quarantine', dq_status FROM s WHERE h4) SELECT rule_id, action, dq_status AS final_status, count(*) AS n FROM g GROUP BY ALL",
    "clean_reconcile": _CLEAN_SQL + ", n AS (SELECT (SELECT count(*) FROM delays) AS rows_in, count(*) FILTER (WHERE dq_status <> 'quarantined') AS clean, (SELECT count(*) FROM delays ANTI JOIN c USING (delay_id)) - count(*) AS removed, count(*) FILTER (WHERE dq_status = 'quarantined') + (SELECT count(*) FROM delays SEMI JOIN c USING (delay_id)) AS quarantined FROM s) SELECT *, rows_in = clean + removed + quarantined AS balanced FROM n",
}

# ---- features


@query("WITH d AS (SELECT DISTINCT service_date FROM trips WHERE service_date IS NOT NULL), r AS (SELECT service_date, row_number() OVER (ORDER BY service_date) AS i, count(*) OVER () AS n FROM d) SELECT service_date, CASE WHEN i <= round(n * 0.7) THEN 'train' WHEN i <= round(n * 0.7) + round(n * 0.15) THEN 'validation' ELSE 'test' END AS split FROM r")
def feat_split(trips):
    return X.split_by_day(trips, "service_date", 0.7, 0.15)


_SPLIT = "WITH d AS (SELECT DISTINCT service_date FROM trips WHERE service_date IS NOT NULL), r AS (SELECT service_date, row_number() OVER (ORDER BY service_date) AS i, count(*) OVER () AS n FROM d) SELECT service_date, CASE WHEN i <= round(n * 0.7) THEN 'train' WHEN i <= round(n * 0.7) + round(n * 0.15) THEN 'validation' ELSE 'test' END AS split FROM r"


@query("SELECT max(service_date) FILTER (WHERE split = 'train') < min(service_date) FILTER (WHERE split = 'validation') AS train_before_validation, max(service_date) FILTER (WHERE split = 'validation') < min(service_date) FILTER (WHERE split = 'test') AS validation_before_test FROM (" + _SPLIT + ")")
def feat_chronology(trips):
    return X.chronology(X.split_by_day(trips, "service_date", 0.7, 0.15), "service_date")


@query("WITH b AS (SELECT route_id, service_date, CAST(hour(entry_time) AS INT) AS h, dayofweek(service_date) IN (0, 6) AS weekend, 1 AS n FROM tickets WHERE route_id <> '' AND entry_time IS NOT NULL), g AS (SELECT route_id, service_date, weekend, h, sum(n) AS x FROM b GROUP BY ALL), s AS (SELECT *, date_diff('day', DATE '1970-01-01', service_date) AS i, x / sum(x) OVER (PARTITION BY route_id, service_date) AS s FROM g) SELECT route_id, service_date, h, weekend, round(avg(s) OVER w, 6) AS share_asof, round(avg(s) OVER w, 6) >= 0.08 AS is_peak FROM s WINDOW w AS (PARTITION BY route_id, h, weekend ORDER BY i RANGE BETWEEN 28 PRECEDING AND 1 PRECEDING)")
def feat_peak_share(tickets):
    rows = tickets.where("route_id != '' and entry_time is not null").select("route_id", "service_date", F.hour("entry_time").alias("h"), F.dayofweek("service_date").isin(1, 7).alias("weekend"), F.lit(1).alias("n"))
    out = X.peak_share(rows, "route_id", "service_date", "h", "weekend", "n")
    return out.withColumn("share_asof", r6(F.col("share_asof"))).withColumn("is_peak", F.col("share_asof") >= 0.08)


@query("WITH t AS (SELECT DISTINCT trip_id, route_id, service_date, trip_status <> 'cancelled' AS ran FROM trips), c AS (SELECT trip_id, max(boardings) AS b FROM passenger_counts GROUP BY 1), g AS (SELECT route_id, service_date, count(*) FILTER (WHERE ran) AS operated, count(b) FILTER (WHERE ran) AS measured, CAST(sum(b) FILTER (WHERE ran) AS BIGINT) AS total FROM t LEFT JOIN c USING (trip_id) GROUP BY ALL) SELECT route_id, service_date, operated, measured, total, round(measured / nullif(operated, 0), 6) AS coverage, round(total::DOUBLE * operated / nullif(measured, 0), 6) AS estimated FROM g")
def feat_route_day(trips, passenger_counts):
    c = passenger_counts.groupBy("trip_id").agg(F.max("boardings").alias("b"))
    t = trips.select("trip_id", "route_id", "service_date", (F.col("trip_status") != "cancelled").alias("ran")).distinct().join(c, "trip_id", "left")
    return X.estimated_total(t, ["route_id", "service_date"], "b", "ran").withColumns({"coverage": r6(F.col("coverage")), "estimated": r6(F.col("estimated"))})


@query("SELECT entry_stop_id AS stop_id, service_date, count(DISTINCT ticket_id) AS boardings FROM tickets WHERE entry_stop_id <> '' GROUP BY ALL")
def feat_stop_day(tickets):
    return tickets.where("entry_stop_id != ''").groupBy(F.col("entry_stop_id").alias("stop_id"), "service_date").agg(F.countDistinct("ticket_id").alias("boardings"))


# ---- the streaming operators, over the whole table as one batch


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling_counts(events):
    return live.tumbling_counts(events, "ts", ["event_type"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT vehicle_id, time_bucket(INTERVAL 3 MINUTE, event_time, TIMESTAMP '1970-01-01') AS window_start, max(event_time) AS event_time, first(event_type ORDER BY event_time DESC, event_id DESC NULLS LAST, event_type DESC NULLS LAST) AS event_type FROM gps_events WHERE vehicle_id <> '' AND event_time IS NOT NULL GROUP BY 1, 2")
def stream_latest_positions(gps_events):
    """The last event of every vehicle window; of several at the last instant the one with the greatest event_id, then event_type."""
    last = live.latest_positions(gps_events.where("vehicle_id != ''"), "vehicle_id", "event_time", ["event_type"], tie=["event_id", "event_type"])
    return last.select("vehicle_id", F.col("window_start").cast("timestamp_ntz"), F.col("event_time").cast("timestamp_ntz"), "event_type")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS i FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, i")
def stream_sessions(events):
    return live.sessions(events, "user_id", "ts").withColumn("start", F.col("start").cast("timestamp_ntz"))
