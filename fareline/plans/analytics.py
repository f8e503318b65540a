"""Transit statements on trips alone: one text per result, for Spark SQL and DuckDB alike.

``ratio`` guards every division; shares leave unmeasured rows out; ranks and picks have tie-breaks; results
are rounded only at the end. The common relations come from ``marts`` in Spark and from a text written by hand in
DuckDB. Statements that need more than trips are in ``transit``, with twins of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fareline.plans import transit
from fareline.plans.dialect import DuckDB, Spark
from fareline.plans.marts import mart
from fareline.plans.transit import register

STATEMENTS: dict[str, Callable[[object], str]] = {}


def statement(f: Callable[[object], str]) -> Callable[[object], str]:
    STATEMENTS[f.__name__] = f
    return f


def ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0e0))"


def share(condition: str, measured: str) -> str:
    return f"avg(CASE WHEN {condition} THEN 1e0 WHEN {measured} IS NOT NULL THEN 0e0 END)"


def base(q) -> str:
    """t: a trip per row; k: a tap per row. In Spark the stored relations of the mart, in DuckDB the twin's own."""
    return q.base()


@statement
def an_headway(q) -> str:
    w = "PARTITION BY route_id, direction, service_date ORDER BY scheduled_departure, trip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    ran = "CASE WHEN trip_status <> 'cancelled' THEN {} END"
    return base(q) + f""",
p AS (
  SELECT trip_id, route_id, direction, period, trip_status, actual_departure, scheduled_departure,
    {q.last_known(ran.format("actual_departure"), w)} AS before_actual, {q.last_known(ran.format("scheduled_departure"), w)} AS before_planned FROM t),
g AS (SELECT *, {q.minutes("before_actual", "actual_departure")} AS gap, {q.minutes("before_planned", "scheduled_departure")} AS planned_gap FROM p WHERE trip_status <> 'cancelled')
SELECT trip_id, route_id, direction, period, round(gap, 6) AS gap, round(planned_gap, 6) AS planned_gap,
  CASE WHEN gap IS NULL OR planned_gap IS NULL OR planned_gap < 3 THEN 'not_judged' WHEN gap < 0 THEN 'overtaken' WHEN gap < 0.5 * planned_gap THEN 'bunched' WHEN gap > 1.5 * planned_gap THEN 'gap' ELSE 'regular' END AS state FROM g"""


@statement
def an_headway_bunching(q) -> str:
    return f"""
SELECT route_id, direction, period, count(*) AS trips, count(CASE WHEN state = 'bunched' THEN 1 END) AS bunched, count(CASE WHEN state = 'gap' THEN 1 END) AS gaps, count(CASE WHEN state = 'overtaken' THEN 1 END) AS overtaken,
  round(avg(gap), 6) AS mean_gap, round(CASE WHEN avg(gap) > 0 THEN stddev(gap) / avg(gap) END, 6) AS gap_cv
FROM ({an_headway(q)}) x GROUP BY route_id, direction, period"""


@statement
def an_route_delay(q) -> str:
    return base(q) + f""",
a AS (SELECT route_id, count(delay) AS judged, round(avg(delay), 6) AS mean_delay, round({share("delay >= 5", "delay")}, 6) AS late_share FROM t GROUP BY route_id)
SELECT *, CAST(rank() OVER (ORDER BY mean_delay DESC NULLS LAST) AS INT) AS delay_rank, CAST(rank() OVER (ORDER BY late_share DESC NULLS LAST) AS INT) AS late_rank FROM a"""


@statement
def an_peak_days(q) -> str:
    return base(q) + " SELECT service_date, dow, CAST(sum(boardings) AS BIGINT) AS boardings, CAST(rank() OVER (ORDER BY sum(boardings) DESC NULLS LAST) AS INT) AS day_rank FROM t GROUP BY service_date, dow"


@statement
def an_travel_time_variation(q) -> str:
    return base(q) + f""",
a AS (
  SELECT route_id, direction, count(travelled) AS n, avg(travelled) AS m, stddev(travelled) AS s, {q.pct("travelled", 0.1)} AS p10, {q.pct("travelled", 0.9)} AS p90
  FROM t WHERE travelled BETWEEN 1 AND 600 GROUP BY route_id, direction)
SELECT route_id, direction, n, round(m, 6) AS mean_min, round(s / nullif(m, 0e0), 6) AS cv, round(p10, 6) AS p10, round(p90, 6) AS p90, CAST(rank() OVER (ORDER BY round(s / nullif(m, 0e0), 6) DESC NULLS LAST) AS INT) AS variation_rank FROM a"""


@statement
def an_direction_demand(q) -> str:
    return base(q) + f""",
d AS (SELECT route_id, day_class, period, direction, sum(boardings) AS b FROM t GROUP BY route_id, day_class, period, direction),
s AS (SELECT *, {ratio("b", "sum(b) OVER (PARTITION BY route_id, day_class, period)")} AS part FROM d)
SELECT route_id, day_class, period, direction, CAST(b AS BIGINT) AS boardings, round(part, 6) AS part, CASE WHEN part >= 0.65 THEN 'dominant' WHEN part <= 0.35 THEN 'minor' WHEN part IS NOT NULL THEN 'balanced' END AS role FROM s"""


@statement
def an_route_hours(q) -> str:
    return base(q) + ", d AS (SELECT route_id, day_class, h, round(avg(boardings), 6) AS mean_boardings FROM t GROUP BY route_id, day_class, h) SELECT *, CAST(rank() OVER (PARTITION BY route_id, day_class ORDER BY mean_boardings DESC NULLS LAST) AS INT) AS hour_rank FROM d"


@statement
def an_overcrowding_trips(q) -> str:
    return base(q) + " SELECT trip_id, route_id, direction, service_date, max_load, capacity, round(occupancy, 6) AS occupancy, band FROM t WHERE occupancy IS NOT NULL"


@statement
def an_overcrowding_summary(q) -> str:
    return base(q) + " SELECT route_id, direction, count(occupancy) AS measured, " + ", ".join(f"count(CASE WHEN band = '{b}' THEN 1 END) AS n_{b}" for b in ("low", "normal", "high", "over")) + " FROM t GROUP BY route_id, direction"


@statement
def an_delay_by_dimension(q) -> str:
    dims = {"route": "route_id", "direction": "CAST(direction AS STRING)", "period": "period", "hour": "CAST(h AS STRING)", "weekday": "CAST(dow AS STRING)", "day_class": "day_class", "month": "ym", "vehicle": "vehicle_id", "band": "band"}
    u = q.rows_of("t", ["dimension", "val"], [[f"'{n}'", c] for n, c in dims.items()])
    return base(q) + f" SELECT dimension, val, count(*) AS trips, count(delay) AS judged, round(avg(delay), 6) AS mean_delay, round({share('delay >= 5', 'delay')}, 6) AS late_share FROM {u} WHERE val IS NOT NULL GROUP BY dimension, val"


@statement
def an_delay_congestion(q) -> str:
    cols = ", ".join(f"avg(CASE WHEN period = '{p}' THEN delay END) AS {p}" for p in ("early", "am_peak", "midday", "pm_peak", "evening"))
    return base(q) + f", p AS (SELECT route_id, {cols} FROM t GROUP BY route_id) SELECT route_id, round(am_peak, 6) AS am_peak, round(midday, 6) AS midday, round(pm_peak, 6) AS pm_peak, round(am_peak - midday, 6) AS am_excess, round(pm_peak - midday, 6) AS pm_excess, coalesce(greatest(am_peak - midday, pm_peak - midday) >= 1, false) AS congested FROM p"


@statement
def an_delay_accumulation(q) -> str:
    return base(q) + " SELECT route_id, direction, period, count(arrival_late) AS n, round(sum(departure_s) / (count(*) * 60e0), 4) AS at_departure, round(sum(arrival_s) / (count(*) * 60e0), 4) AS at_arrival, round(sum(arrival_s - departure_s) / (count(*) * 60e0), 4) AS gained FROM t WHERE abs(arrival_late) <= 600 AND abs(departure_late) <= 600 GROUP BY route_id, direction, period"


@statement
def an_delay_consistent(q) -> str:
    return base(q) + f""",
e AS (SELECT kind, entity, service_date, delay FROM {q.rows_of("t", ["kind", "entity"], [["'route'", "route_id"], ["'vehicle'", "vehicle_id"]])} WHERE entity <> ''),
s AS (SELECT service_date, round(avg(delay), 6) AS system_delay FROM t GROUP BY service_date),
d AS (SELECT kind, entity, service_date, round(avg(delay), 6) AS m FROM e WHERE delay IS NOT NULL GROUP BY kind, entity, service_date)
SELECT kind, entity, count(*) AS days, count(CASE WHEN m > system_delay THEN 1 END) AS above, {ratio("count(CASE WHEN m > system_delay THEN 1 END)", "count(*)")} >= 0.75 AS consistent FROM d JOIN s ON d.service_date = s.service_date GROUP BY kind, entity"""


@statement
def an_delay_top_trips(q) -> str:
    return base(q) + " SELECT trip_id, route_id, service_date, round(delay, 6) AS delay FROM t WHERE delay IS NOT NULL ORDER BY round(delay, 6) DESC, trip_id LIMIT 500"


@statement
def an_travel_time_analysis(q) -> str:
    return base(q) + f""",
c AS (SELECT route_id, direction, day_class, period, count(travelled) AS n, avg(travelled) AS m FROM t WHERE travelled BETWEEN 1 AND 600 GROUP BY route_id, direction, day_class, period)
SELECT route_id, direction, day_class, period, n, round(m, 6) AS mean_min, round(sum(m * n) OVER w / sum(n) OVER w, 6) AS usual_min, round({ratio("m", "sum(m * n) OVER w / sum(n) OVER w")}, 6) AS against FROM c WINDOW w AS (PARTITION BY route_id, direction)"""


@statement
def an_peak_offpeak(q) -> str:
    peak, off = "avg(CASE WHEN period IN ('am_peak', 'pm_peak') THEN travelled END)", "avg(CASE WHEN period = 'midday' THEN travelled END)"
    return base(q) + f" SELECT route_id, direction, round({peak}, 6) AS peak_min, round({off}, 6) AS offpeak_min, round({ratio(peak, off)} - 1, 6) AS penalty FROM t WHERE travelled BETWEEN 1 AND 600 GROUP BY route_id, direction"


@statement
def an_route_reliability(q) -> str:
    return base(q) + f""",
cells AS (SELECT route_id, direction, period, stddev(travelled) / nullif(avg(travelled), 0e0) AS cv FROM t WHERE travelled BETWEEN 1 AND 600 GROUP BY route_id, direction, period),
v AS (SELECT route_id, avg(cv) AS cv FROM cells GROUP BY route_id),
a AS (SELECT route_id, count(arrival_late) AS n, {share("arrival_late < -1", "arrival_late")} AS early, {share("arrival_late > 5", "arrival_late")} AS late, stddev(arrival_late) AS spread FROM t WHERE abs(arrival_late) <= 600 GROUP BY route_id)
SELECT a.route_id, n, round(early, 6) AS early_share, round(late, 6) AS late_share, round(spread, 6) AS spread, round(cv, 6) AS mean_cv, CAST(rank() OVER (ORDER BY round(late, 6) NULLS LAST) AS INT) AS reliability_rank FROM a LEFT JOIN v ON a.route_id = v.route_id"""


def run(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(mart(spark, sf_dir))
        return spark.sql(STATEMENTS[name](Spark()))

    return query


QUERIES = {name: run(name) for name in STATEMENTS} | transit.QUERIES
SQL = {name: f(DuckDB()) for name, f in STATEMENTS.items()} | transit.SQL
