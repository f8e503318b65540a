"""SQL twins of the transit statements, written by hand for DuckDB over the source tables."""

from __future__ import annotations

HOLIDAYS = """
hol AS (SELECT * FROM (VALUES (DATE '2024-01-01', 'New Year'), (DATE '2024-05-01', 'Labour Day'), (DATE '2024-12-25', 'Christmas Day'), (DATE '2024-12-26', 'Second Christmas Day')) v(service_date, holiday))"""


def _period(x: str) -> str:
    return f"CASE WHEN {x} BETWEEN 0 AND 6 THEN 'early' WHEN {x} BETWEEN 7 AND 9 THEN 'am_peak' WHEN {x} BETWEEN 10 AND 15 THEN 'midday' WHEN {x} BETWEEN 16 AND 18 THEN 'pm_peak' WHEN {x} >= 19 THEN 'evening' END"


def _s(a: str, b: str) -> str:
    return f"date_diff('second', {a}, {b})"


#: t: a trip per row; k: a tap per row.
BASE = f"""
WITH {HOLIDAYS},
pk AS (
  SELECT route_id, service_date, h, round(avg(s) OVER (PARTITION BY route_id, h, weekend ORDER BY day_no RANGE BETWEEN 28 PRECEDING AND 1 PRECEDING), 6) AS peak_share
  FROM (SELECT *, date_diff('day', DATE '1970-01-01', service_date) AS day_no, n / sum(n) OVER (PARTITION BY route_id, service_date) AS s FROM (
    SELECT route_id, service_date, hour(entry_time) AS h, dayofweek(service_date) IN (0, 6) AS weekend, count(*) AS n FROM tickets WHERE route_id <> '' AND entry_time IS NOT NULL GROUP BY ALL))),
counted AS (
  SELECT trip_id, max(boardings) AS boardings, max(max_load) AS max_load, max(denied_boardings) AS denied, arg_max(max_load_stop_id, (max_load, max_load_stop_id)) AS load_stop
  FROM passenger_counts WHERE boardings >= 0 AND max_load BETWEEN 0 AND 400 GROUP BY 1),
late AS (SELECT trip_id, round(avg(delay_minutes), 6) AS delay FROM (SELECT DISTINCT * FROM delays) WHERE delay_minutes BETWEEN -60 AND 600 GROUP BY 1),
fleet AS (SELECT vehicle_id, arg_max(capacity_total, (effective_from, recorded_at, version_id)) AS capacity FROM vehicles GROUP BY 1),
plan AS (SELECT schedule_id, max(headway_min) AS headway, max(planned_runtime_min) AS runtime FROM schedules WHERE schedule_id <> '' GROUP BY 1),
line AS (SELECT route_id, max(route_type) AS route_type, max(distance_km) FILTER (WHERE distance_km BETWEEN 0.1 AND 200) AS distance_km FROM routes WHERE route_id <> '' GROUP BY 1),
t AS (
  SELECT x.*, {_period("h")} AS period, CASE WHEN holiday IS NOT NULL THEN 'holiday' WHEN dow IN (1, 7) THEN 'weekend' ELSE 'weekday' END AS day_class,
    CASE WHEN occupancy < 0.25 THEN 'low' WHEN occupancy < 0.75 THEN 'normal' WHEN occupancy < 1 THEN 'high' WHEN occupancy IS NOT NULL THEN 'over' END AS band, peak_share >= 0.08 AS peak
  FROM (
    SELECT tr.* EXCLUDE (original_vehicle_id, cancellation_reason, received_at, actual_arrival), hour(scheduled_departure)::INT AS h, strftime(service_date, '%Y-%m') AS ym, (dayofweek(service_date) + 1)::INT AS dow, date_diff('day', DATE '1970-01-01', service_date)::INT AS day_no,
      {_s("scheduled_departure", "scheduled_arrival")} AS planned_s, {_s("actual_departure", "actual_arrival")} AS travelled_s, {_s("scheduled_arrival", "actual_arrival")} AS arrival_s, {_s("scheduled_departure", "actual_departure")} AS departure_s,
      {_s("scheduled_departure", "scheduled_arrival")} / 60e0 AS planned, {_s("actual_departure", "actual_arrival")} / 60e0 AS travelled, {_s("scheduled_arrival", "actual_arrival")} / 60e0 AS arrival_late, {_s("scheduled_departure", "actual_departure")} / 60e0 AS departure_late,
      boardings, max_load, denied, load_stop, delay, capacity, max_load::DOUBLE / nullif(capacity, 0) AS occupancy, headway, runtime, route_type, distance_km, holiday, peak_share, trip_status IN ('completed', 'partial') AS ran
    FROM (SELECT DISTINCT * FROM trips WHERE route_id <> '') tr LEFT JOIN counted USING (trip_id) LEFT JOIN late USING (trip_id) LEFT JOIN fleet USING (vehicle_id) LEFT JOIN plan USING (schedule_id) LEFT JOIN line USING (route_id) LEFT JOIN hol USING (service_date)
      LEFT JOIN pk ON pk.route_id = tr.route_id AND pk.service_date = tr.service_date AND pk.h = hour(scheduled_departure)) x),
k AS (SELECT DISTINCT ticket_id, passenger_id, trip_id, route_id, service_date, entry_stop_id, exit_stop_id, entry_time, exit_time, fare_category FROM tickets WHERE trip_id <> '' AND entry_stop_id <> '')"""

_DAYS = """,
n_class AS (SELECT day_class, count(DISTINCT service_date) AS days FROM t GROUP BY 1),
n_all AS (SELECT count(DISTINCT service_date) AS days FROM t)"""

_FACTORS = """,
nt AS (SELECT trip_id, count(*) AS n FROM k GROUP BY 1),
c0 AS (SELECT route_id, ym, period, sum(boardings) AS counted, sum(coalesce(n, 0)) FILTER (WHERE boardings IS NOT NULL) AS taps FROM t LEFT JOIN nt USING (trip_id) GROUP BY ALL),
f AS (
  SELECT c0.*, CASE WHEN c0.taps >= 30 THEN c0.counted / c0.taps WHEN r.taps >= 30 THEN r.counted / r.taps ELSE m.counted / m.taps END AS factor,
    CASE WHEN c0.taps >= 30 THEN 'cell' WHEN r.taps >= 30 THEN 'route_month' ELSE 'month' END AS factor_level
  FROM c0 JOIN (SELECT route_id, ym, sum(counted) AS counted, sum(taps) AS taps FROM c0 GROUP BY ALL) r USING (route_id, ym)
    JOIN (SELECT ym, sum(counted) AS counted, nullif(sum(taps), 0) AS taps FROM c0 GROUP BY ALL) m USING (ym))"""

_PLACES = """,
pl AS (
  SELECT *, row_number() OVER (PARTITION BY route_id, direction ORDER BY place, stop_id)::INT AS seq, (count(*) OVER (PARTITION BY route_id, direction))::INT AS stops
  FROM (
    SELECT route_id, direction, stop_id, (sum(least(greatest(date_diff('second', scheduled_departure, event_time), 0), planned_s) * 1000000 // planned_s) // count(*))::BIGINT AS place
    FROM (SELECT DISTINCT event_id, trip_id, stop_id, event_time FROM gps_events WHERE stop_id <> '' AND trip_id <> '') g JOIN (SELECT trip_id, route_id, direction, scheduled_departure, planned_s FROM t) USING (trip_id)
    WHERE planned_s > 0 AND direction IS NOT NULL GROUP BY ALL))"""

_RIDES = (
    _FACTORS
    + _PLACES
    + f""",
ride AS (
  SELECT k.* EXCLUDE (route_id, service_date), t.route_id, t.direction, t.route_type, t.service_date, t.dow, t.day_no, t.ym, t.period, t.day_class, t.service_id AS day_type, f.factor, hour(k.entry_time)::INT AS entry_h,
    {_period("hour(k.entry_time)")} AS entry_period, {_period("hour(k.exit_time)")} AS exit_period, {_s("k.entry_time", "k.exit_time")} AS ride_s,
    coalesce(abs(pb.place - pa.place) / 1e6 * t.distance_km, 2 * 6371e0 * asin(least(1e0, sqrt(pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2))))) AS km
  FROM k JOIN t ON k.trip_id = t.trip_id JOIN f ON f.route_id = t.route_id AND f.ym = t.ym AND f.period = t.period
    LEFT JOIN pl pa ON pa.route_id = t.route_id AND pa.direction = t.direction AND pa.stop_id = k.entry_stop_id
    LEFT JOIN pl pb ON pb.route_id = t.route_id AND pb.direction = t.direction AND pb.stop_id = k.exit_stop_id
    LEFT JOIN stops a ON a.stop_id = k.entry_stop_id LEFT JOIN stops b ON b.stop_id = k.exit_stop_id)"""
)

_EVENTS = """,
kinds AS (SELECT service_date, arg_max(service_id, (n, service_id)) AS day_type FROM (SELECT service_date, service_id, count(*) AS n FROM t GROUP BY ALL) GROUP BY 1),
rd AS (SELECT route_id, service_date, dow, day_no, holiday, sum(boardings) AS b, count(boardings) AS measured, count(*) FILTER (WHERE ran) AS operated, count(*) FILTER (WHERE trip_type = 'extra') AS extra_trips FROM t GROUP BY ALL HAVING count(boardings) > 0),
dm AS (SELECT rd.*, day_type, (b * operated)::DOUBLE / measured AS demand FROM rd JOIN kinds USING (service_date)),
hi AS (SELECT *, list_sort(list(demand) OVER (PARTITION BY route_id, dow, day_type ORDER BY day_no RANGE BETWEEN 56 PRECEDING AND 7 PRECEDING)) AS h FROM dm),
ev0 AS (SELECT *, coalesce(len(h), 0)::INT AS n, (h[(len(h) + 1) // 2] + h[len(h) // 2 + 1]) / 2 AS expected FROM hi),
ev1 AS (SELECT *, round(demand / nullif(expected, 0), 6) AS against FROM ev0),
ev AS (SELECT *, CASE WHEN n < 4 THEN 'unknown' WHEN against >= 1.5 THEN 'spike' WHEN against <= 0.5 THEN 'drop' ELSE 'normal' END AS state FROM ev1),
normal AS (SELECT route_id, service_date FROM ev WHERE state NOT IN ('spike', 'drop') AND holiday IS NULL)"""

_PERSISTENT = (
    _EVENTS
    + """,
pd AS (SELECT route_id, direction, dow, period, service_date, max((band IN ('high', 'over'))::INT) AS hit, max(occupancy) AS most FROM t WHERE band IS NOT NULL GROUP BY ALL),
pn AS (SELECT pd.*, normal.route_id IS NOT NULL AS ok FROM pd LEFT JOIN normal USING (route_id, service_date)),
pc AS (SELECT route_id, direction, dow, period, count(*) FILTER (WHERE ok) AS days, coalesce(sum(hit) FILTER (WHERE ok), 0)::BIGINT AS overloaded, coalesce(sum(hit) FILTER (WHERE NOT ok), 0)::BIGINT AS on_event_days, round(max(most) FILTER (WHERE ok), 4) AS most FROM pn GROUP BY ALL),
persistent AS (
  SELECT *, round(overloaded / nullif(days, 0), 4) AS part,
    CASE WHEN days < 4 THEN 'unknown' WHEN overloaded >= 4 AND overloaded >= 0.5 * days THEN 'persistent' WHEN overloaded = 0 THEN 'none' WHEN overloaded <= 2 THEN 'one_off' ELSE 'recurring' END AS pattern FROM pc)"""
)

_USAGE = """,
u_in AS (SELECT entry_stop_id AS stop_id, count(*) AS n, sum(factor) AS e FROM ride GROUP BY 1),
u_out AS (SELECT exit_stop_id AS stop_id, count(*) AS n, sum(factor) AS e FROM ride WHERE exit_stop_id <> '' GROUP BY 1),
span AS (SELECT min(service_date) AS a, max(service_date) AS b FROM t),
us AS (SELECT stop_id, stop_name, zone, stop_type, (date_diff('day', greatest(coalesce(opened_date, a), a), b) + 1)::INT AS days_open FROM stops, span),
u0 AS (
  SELECT us.*, coalesce(i.n, 0) AS taps_in, coalesce(o.n, 0) AS taps_out, round(coalesce(i.e, 0) / days_open, 2) AS in_per_day, round(coalesce(o.e, 0) / days_open, 2) AS out_per_day, round((coalesce(i.e, 0) + coalesce(o.e, 0)) / days_open, 2) AS turnover
  FROM us LEFT JOIN u_in i USING (stop_id) LEFT JOIN u_out o USING (stop_id)),
usage AS (SELECT *, dense_rank() OVER (ORDER BY turnover DESC NULLS LAST)::INT AS usage_rank FROM u0)"""

_PATTERNS = """,
sp AS (
  SELECT stop_id, day_class, period, round(sum(a), 4) AS a, round(sum(b), 4) AS b FROM (
    SELECT entry_stop_id AS stop_id, day_class, entry_period AS period, factor AS a, 0e0 AS b FROM ride
    UNION ALL SELECT exit_stop_id, day_class, exit_period, 0, factor FROM ride WHERE exit_stop_id <> '') GROUP BY ALL),
patterns AS (
  SELECT stop_id, day_class, period, round(a / days, 6) AS in_per_day, round(b / days, 6) AS out_per_day, round((a - b) / days, 6) AS net_per_day,
    CASE WHEN a >= 1.5 * b THEN 'origin' WHEN b >= 1.5 * a THEN 'destination' ELSE 'balanced' END AS pattern FROM sp JOIN n_class USING (day_class))"""

_RECORDS = """,
rec AS (
  SELECT d.*, route_id, direction, route_type, period FROM (SELECT DISTINCT delay_id, trip_id, stop_id, delay_minutes, lower(trim(delay_reason)) AS why FROM delays WHERE delay_minutes BETWEEN -60 AND 600 AND stop_id <> '') d
  JOIN (SELECT trip_id, route_id, direction, route_type, period FROM t) USING (trip_id))"""

_BY_STOP = (
    _RECORDS
    + """,
ra AS (SELECT stop_id, count(*) AS records, round(avg(delay_minutes), 6) AS mean_delay, count(*) FILTER (WHERE why IN ('traffic', 'boarding', 'road works')) AS congestion FROM rec GROUP BY 1),
rw AS (SELECT stop_id, arg_min(why, (-n, why)) AS main_reason FROM (SELECT stop_id, why, count(*) AS n FROM rec WHERE why IS NOT NULL GROUP BY ALL) GROUP BY 1),
op AS (SELECT route_id, direction, count(*) FILTER (WHERE ran) AS operated FROM t GROUP BY ALL),
ex AS (SELECT stop_id, sum(operated)::BIGINT AS served, count(DISTINCT route_id) AS routes FROM pl JOIN op USING (route_id, direction) GROUP BY 1),
bs AS (
  SELECT stop_id, stop_name, zone, stop_type, served, routes, coalesce(records, 0) AS records, mean_delay, coalesce(congestion, 0) AS congestion, main_reason, round(coalesce(records, 0) / nullif(served, 0), 6) AS record_rate, round(coalesce(congestion, 0) / nullif(served, 0), 6) AS congestion_rate
  FROM stops JOIN ex USING (stop_id) LEFT JOIN ra USING (stop_id) LEFT JOIN rw USING (stop_id)),
by_stop AS (SELECT *, round(percent_rank() OVER (ORDER BY congestion_rate NULLS FIRST), 4) AS place FROM bs)"""
)

_HOURS = "(CASE period WHEN 'early' THEN 7 WHEN 'am_peak' THEN 3 WHEN 'midday' THEN 6 WHEN 'pm_peak' THEN 3 ELSE 5 END)"
_SUPPLY = """,
su AS (
  SELECT route_id, direction, day_class, period, max(distance_km) AS distance_km, count(DISTINCT service_date) AS days, count(*) AS trips, count(*) FILTER (WHERE ran) AS operated, count(occupancy) AS measured, avg(occupancy) AS occupancy, quantile_disc(occupancy, 0.9) AS p90,
    avg(boardings) AS per_trip, avg((band IN ('high', 'over'))::INT) AS overload, avg(peak::INT) AS peak_rate, sum(arrival_s) / (count(arrival_s) * 60) AS arrival_late
  FROM t GROUP BY ALL)"""

_MEDIANS = ("occupancy", "p90", "on_time", "late", "stretch", "spread", "under", "over", "severity")
_PERFORMANCE = (
    _PERSISTENT
    + f""",
nt2 AS (SELECT t.* FROM t SEMI JOIN normal USING (route_id, service_date)),
pday AS (
  SELECT route_id, service_date, round(avg(occupancy), 6) AS occupancy, round(quantile_disc(occupancy, 0.9), 6) AS p90, round(avg((arrival_late BETWEEN -1 AND 5)::INT), 6) AS on_time, round(avg((delay >= 5)::INT), 6) AS late, round(avg(travelled_s / nullif(planned_s, 0)), 6) AS stretch, round(stddev(arrival_s), 6) AS spread,
    round(avg((band = 'low')::INT), 6) AS under, round(avg((band IN ('high', 'over'))::INT), 6) AS over, round(avg(CASE band WHEN 'over' THEN 1e0 WHEN 'high' THEN 0.5e0 WHEN 'low' THEN 0e0 WHEN 'normal' THEN 0e0 END), 6) AS severity, count(occupancy) AS measured, count(*) FILTER (WHERE ran) AS operated
  FROM nt2 GROUP BY ALL),
pa2 AS (SELECT route_id, count(*) AS days, sum(measured)::DOUBLE / nullif(sum(operated), 0) AS coverage, {", ".join(f"quantile_disc({c}, 0.5) AS {c}" for c in _MEDIANS)} FROM pday GROUP BY 1),
pdem AS (SELECT route_id, round(quantile_disc(demand, 0.5), 2) AS demand FROM ev SEMI JOIN normal USING (route_id, service_date) GROUP BY 1),
pcell AS (
  SELECT route_id, count(*) FILTER (WHERE pattern = 'persistent') AS cells, count(*) FILTER (WHERE pattern IN ('one_off', 'recurring')) AS other_cells, round(coalesce(count(*) FILTER (WHERE pattern = 'persistent') / nullif(count(*) FILTER (WHERE pattern <> 'unknown'), 0), 0), 6) AS cell_share,
    coalesce(string_agg(DISTINCT direction::VARCHAR, ',' ORDER BY direction::VARCHAR) FILTER (WHERE pattern = 'persistent'), '') AS directions FROM persistent GROUP BY 1),
pspot AS (SELECT route_id, arg_max(load_stop, (n, load_stop)) AS hot_stop, round(max(n) / sum(n), 4) AS hot_share FROM (SELECT route_id, load_stop, count(*) AS n FROM nt2 WHERE band IN ('high', 'over') AND load_stop IS NOT NULL GROUP BY ALL) GROUP BY 1),
podd AS (SELECT route_id, count(*) FILTER (WHERE state IN ('spike', 'drop') OR holiday IS NOT NULL) AS odd_days FROM ev GROUP BY 1),
p0 AS (
  SELECT r.route_id, r.route_type, coalesce(days, 0) AS days, coverage, {", ".join(_MEDIANS)}, demand, coalesce(cells, 0) AS cells, coalesce(other_cells, 0) AS other_cells, coalesce(cell_share, 0) AS cell_share, directions, hot_stop, hot_share, coalesce(odd_days, 0) AS odd_days,
    coalesce(days >= 20 AND coverage >= 0.5 AND demand IS NOT NULL AND occupancy IS NOT NULL, false) AS eligible
  FROM (SELECT DISTINCT route_id, route_type FROM routes WHERE route_id <> '') r LEFT JOIN pa2 USING (route_id) LEFT JOIN pdem USING (route_id) LEFT JOIN pcell USING (route_id) LEFT JOIN pspot USING (route_id) LEFT JOIN podd USING (route_id)),
p1 AS (SELECT *, round(0.5 * severity + 0.5 * cell_share, 6) AS penalty FROM p0),
p2 AS (
  SELECT *, {", ".join(f"CASE WHEN eligible THEN round(100 * percent_rank() OVER (PARTITION BY eligible ORDER BY {x} NULLS FIRST), 2) END AS {k}_score" for k, x in (("demand", "demand"), ("punctuality", "on_time"), ("delay", "-late"), ("travel", "-stretch"), ("reliability", "-spread"), ("load", "-p90")))},
    CASE WHEN eligible THEN round(100 * greatest(0, 1 - abs(occupancy - 0.7) / 0.7), 2) END AS occupancy_score, CASE WHEN eligible THEN round(100 * (1 - under), 2) END AS use_score, CASE WHEN eligible THEN round(100 * greatest(0, 1 - penalty / 0.5), 2) END AS crowding_score FROM p1),
p3 AS (
  SELECT *, round(0.2 * demand_score + 0.15 * occupancy_score + 0.15 * punctuality_score + 0.1 * delay_score + 0.1 * travel_score + 0.1 * reliability_score + 0.05 * load_score + 0.05 * use_score + 0.1 * crowding_score, 3) AS score,
    round((punctuality_score + delay_score + reliability_score) / 3, 3) AS steady FROM p2),
p4 AS (SELECT *, CASE WHEN eligible THEN round(percent_rank() OVER (PARTITION BY eligible ORDER BY score NULLS FIRST), 4) END AS score_place, CASE WHEN eligible THEN round(percent_rank() OVER (PARTITION BY eligible ORDER BY steady NULLS FIRST), 4) END AS steady_place FROM p3),
p5 AS (
  SELECT *, CASE WHEN NOT eligible THEN 'too_little_known' WHEN score_place >= 0.7 THEN 'strong' WHEN score_place <= 0.3 THEN 'weak' WHEN over >= 0.2 THEN 'crowded' WHEN demand_score >= 70 AND steady_place <= 0.3 THEN 'wanted_but_shaky'
    WHEN steady_place >= 0.7 AND (demand_score <= 30 OR under >= 0.5) THEN 'steady_but_idle' ELSE 'mixed' END AS class FROM p4)
SELECT route_id, route_type, eligible, days, odd_days, round(coverage, 4) AS coverage, demand, {", ".join(f"round({c}, 4) AS {c}" for c in _MEDIANS)}, cells, other_cells, cell_share, penalty,
  demand_score, occupancy_score, punctuality_score, delay_score, travel_score, reliability_score, load_score, use_score, crowding_score, score, score_place, steady_place, class,
  CASE WHEN NOT eligible THEN concat_ws('; ', CASE WHEN days < 20 THEN 'normal days ' || days END, CASE WHEN coverage < 0.5 THEN 'few trips counted' END) WHEN class IN ('strong', 'weak') THEN 'place of the score' WHEN class = 'crowded' THEN 'overloads of the median day'
    WHEN class = 'mixed' THEN 'no criterion of the middle band' ELSE 'demand against steadiness' END AS reason,
  cells > 0 AS overcrowded, CASE WHEN cells > 0 THEN CASE WHEN directions LIKE '%,%' THEN 'both' ELSE 'direction ' || directions END END AS scope, CASE WHEN cells > 0 THEN CASE WHEN hot_share >= 0.6 THEN 'one_stop' ELSE 'whole_route' END END AS location, hot_stop, hot_share
FROM p5"""
)

_HEADWAY = """,
hw0 AS (
  SELECT trip_id, route_id, direction, period, day_class, trip_status, actual_departure, scheduled_departure,
    last_value(CASE WHEN trip_status <> 'cancelled' THEN actual_departure END IGNORE NULLS) OVER w AS before_actual, last_value(CASE WHEN trip_status <> 'cancelled' THEN scheduled_departure END IGNORE NULLS) OVER w AS before_planned
  FROM t WINDOW w AS (PARTITION BY route_id, direction, service_date ORDER BY scheduled_departure, trip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
hw1 AS (SELECT *, (epoch_us(actual_departure) - epoch_us(before_actual)) / 6e7 AS gap, (epoch_us(scheduled_departure) - epoch_us(before_planned)) / 6e7 AS planned_gap FROM hw0 WHERE trip_status <> 'cancelled'),
hw AS (SELECT *, CASE WHEN gap IS NULL OR planned_gap IS NULL OR planned_gap < 3 THEN 'not_judged' WHEN gap < 0 THEN 'overtaken' WHEN gap < 0.5 * planned_gap THEN 'bunched' WHEN gap > 1.5 * planned_gap THEN 'gap' ELSE 'regular' END AS state FROM hw1)"""

_ANOMALIES = (
    _RIDES
    + _EVENTS
    + """,
on_route AS (SELECT DISTINCT route_id, stop_id FROM pl),
off AS (
  SELECT r.*, x.stop_id IS NOT NULL AS entry_on, y.stop_id IS NOT NULL AS exit_on FROM ride r LEFT JOIN on_route x ON x.route_id = r.route_id AND x.stop_id = r.entry_stop_id LEFT JOIN on_route y ON y.route_id = r.route_id AND y.stop_id = r.exit_stop_id),
lg AS (
  SELECT *, lag(entry_time) OVER w AS in_before, lag(exit_time) OVER w AS out_before, lag(entry_stop_id) OVER w AS stop_before FROM ride WHERE passenger_id <> '' AND entry_time IS NOT NULL WINDOW w AS (PARTITION BY passenger_id ORDER BY entry_time, ticket_id)),
sd AS (SELECT entry_stop_id AS stop_id, service_date, dow, day_no, count(*) AS taps FROM ride GROUP BY ALL),
sh AS (SELECT *, list_sort(list(taps) OVER (PARTITION BY stop_id, dow ORDER BY day_no RANGE BETWEEN 56 PRECEDING AND 7 PRECEDING)) AS h FROM sd),
su2 AS (SELECT *, CASE WHEN len(h) >= 4 THEN h[(len(h) + 1) // 2] END AS usual FROM sh),
anomalies AS (
  SELECT 'demand_' || state AS kind, 'route' AS entity_type, route_id AS entity, service_date, round(demand, 3) AS observed, round(expected, 3) AS expected, coalesce(holiday, '') AS detail FROM ev WHERE state IN ('spike', 'drop')
  UNION ALL SELECT 'long_delay', 'trip', trip_id, service_date, round(delay, 3), NULL, route_id FROM t WHERE delay >= 60
  UNION ALL SELECT 'load_over_boardings', 'trip', trip_id, service_date, max_load, boardings, route_id FROM t WHERE max_load > boardings
  UNION ALL SELECT 'denied_though_empty', 'trip', trip_id, service_date, denied, round(occupancy, 3), route_id FROM t WHERE denied > 0 AND occupancy < 0.5
  UNION ALL SELECT 'travel_time', 'trip', trip_id, service_date, travelled_s, planned_s, route_id FROM t WHERE travelled_s / nullif(planned_s, 0) < 0.5 OR travelled_s / nullif(planned_s, 0) > 2
  UNION ALL SELECT 'stop_not_on_route', 'ticket', ticket_id, service_date, NULL, NULL, concat_ws(' ', route_id, CASE WHEN NOT entry_on THEN 'entry ' || entry_stop_id END, CASE WHEN NOT exit_on THEN 'exit ' || exit_stop_id END) FROM off WHERE NOT (entry_on AND exit_on)
  UNION ALL SELECT 'repeated_tap', 'ticket', ticket_id, service_date, date_diff('second', in_before, entry_time), NULL, CASE WHEN entry_time < out_before THEN 'overlap' ELSE 'repeat' END FROM lg WHERE (date_diff('second', in_before, entry_time) <= 120 AND entry_stop_id = stop_before) OR entry_time < out_before
  UNION ALL SELECT 'stop_activity', 'stop', stop_id, service_date, taps, usual, '' FROM su2 WHERE usual >= 3 AND (taps >= 3 * usual OR taps <= 0.2 * usual))"""
)

_SEGMENTS = (
    _RIDES
    + """,
sc AS (SELECT passenger_id, arg_min(fare_category, (-n, fare_category)) AS category FROM (SELECT passenger_id, fare_category, count(*) AS n FROM ride WHERE passenger_id <> '' AND fare_category IS NOT NULL GROUP BY ALL) GROUP BY 1),
sg AS (
  SELECT passenger_id, count(*) AS rides, count(DISTINCT service_date) AS days, greatest(1e0, (date_diff('day', min(service_date), max(service_date)) + 1) / 7e0) AS weeks, round(avg((day_class = 'weekday')::INT), 4) AS weekday, round(avg((day_class = 'weekend')::INT), 4) AS weekend,
    round(avg(coalesce(entry_period IN ('am_peak', 'pm_peak'), false)::INT), 4) AS peak, round(avg(km), 4) AS km, round(sum(factor), 2) AS stands_for FROM ride WHERE passenger_id <> '' GROUP BY 1),
sl AS (SELECT sg.* EXCLUDE (weeks), round(weeks, 2) AS weeks, category, round(days / sg.weeks, 3) AS a_week, (SELECT quantile_disc(km, 0.8) FROM sg) AS long_km FROM sg LEFT JOIN sc USING (passenger_id)),
segments AS (SELECT *, CASE WHEN a_week >= 3 AND weekday >= 0.8 THEN 'commuter' WHEN weekend >= 0.5 THEN 'weekend' WHEN km >= long_km THEN 'long_distance' WHEN peak >= 0.7 THEN 'peak_hour' ELSE 'occasional' END AS segment FROM sl)"""
)

SQL = {
    "an_holidays": f"WITH {HOLIDAYS} SELECT * FROM hol",
    "an_trip_view": BASE + " SELECT trip_id, route_id, direction, service_date, service_id, trip_type, h, ym, dow, period, day_class, holiday, route_type, distance_km, boardings, max_load, denied, load_stop, capacity, band, ran, headway, runtime, peak_share, peak, round(delay, 4) AS delay, round(occupancy, 4) AS occupancy, round(planned, 4) AS planned, round(travelled, 4) AS travelled, round(arrival_late, 4) AS arrival_late, round(departure_late, 4) AS departure_late FROM t",
    "an_ticket_view": BASE + _RIDES + " SELECT ticket_id, passenger_id, route_id, direction, route_type, service_date, day_class, day_type, period, entry_h, entry_period, exit_period, round(ride_s / 60, 2) AS ride_min, round(factor, 6) AS factor, round(km, 8) AS km FROM ride",
    "an_expansion_factor": BASE + _FACTORS + " SELECT route_id, ym, period, counted::BIGINT AS counted, taps::BIGINT AS taps, round(factor, 6) AS factor, factor_level FROM f",
    "an_special_event_route_days": BASE + _EVENTS + " SELECT route_id, service_date, dow, day_type, round(demand, 2) AS demand, n, round(expected, 2) AS expected, against, holiday IS NOT NULL AS is_holiday, holiday, extra_trips, state FROM ev",
    "an_special_event_dates": BASE + _EVENTS + " SELECT service_date, count(*) AS routes, count(*) FILTER (WHERE state = 'spike') AS spikes, count(*) FILTER (WHERE state = 'drop') AS drops, coalesce(string_agg(DISTINCT route_id, ',' ORDER BY route_id) FILTER (WHERE state = 'spike'), '') AS spiking, max(holiday) AS holiday, count(*) FILTER (WHERE state = 'spike') >= 3 AS city_wide FROM ev GROUP BY 1",
    "an_normal_days": BASE + _EVENTS + " SELECT * FROM normal",
    "an_route_demand": BASE + _EVENTS + ", d AS (SELECT route_id, count(*) AS days, round(sum(demand), 1) AS total, round(avg(demand), 2) AS per_day, round(avg(measured / nullif(operated, 0)), 4) AS coverage FROM ev GROUP BY 1) SELECT route_id, route_code, r.route_type, launch_date, days, total, per_day, coverage, dense_rank() OVER (ORDER BY per_day DESC NULLS LAST)::INT AS demand_rank FROM d JOIN (SELECT DISTINCT route_id, route_code, route_type, launch_date FROM routes WHERE route_id <> '') r USING (route_id)",
    "an_stop_usage": BASE + _RIDES + _USAGE + " SELECT * FROM usage",
    "an_peak_hours": BASE + " SELECT day_class, h, count(DISTINCT service_date) AS days, count(*) AS trips, count(boardings) AS measured, round(sum(boardings) / nullif(count(boardings), 0), 4) AS per_trip, round((sum(boardings) * count(*) FILTER (WHERE ran)) / nullif(count(boardings) * count(DISTINCT service_date), 0), 4) AS per_day, round(avg(occupancy), 4) AS occupancy, round(avg(peak::INT), 4) AS peak_rate FROM t GROUP BY ALL",
    "an_stop_patterns": BASE + _DAYS + _RIDES + _PATTERNS + " SELECT * FROM patterns",
    "an_od_pairs": BASE + _DAYS + _RIDES + ", g AS (SELECT entry_stop_id, exit_stop_id, count(*) AS journeys, round(sum(factor), 3) AS est, round(avg(km), 3) AS km, round(avg(ride_s) / 60, 2) AS ride_min, count(DISTINCT route_id) AS routes FROM ride WHERE exit_stop_id <> '' GROUP BY ALL) SELECT *, round(est / (SELECT days FROM n_all), 4) AS per_day, dense_rank() OVER (ORDER BY est DESC NULLS LAST)::INT AS flow_rank FROM g",
    "an_load_profile": BASE + _RIDES + ", d AS (SELECT route_id, count(DISTINCT service_date) AS days FROM t GROUP BY 1), a AS (SELECT route_id, direction, entry_stop_id AS stop_id, sum(factor) AS e FROM ride GROUP BY ALL), b AS (SELECT route_id, direction, exit_stop_id AS stop_id, sum(factor) AS e FROM ride GROUP BY ALL) SELECT route_id, direction, seq, stop_id, place, round(coalesce(a.e, 0) / days, 4) AS in_per_day, round(coalesce(b.e, 0) / days, 4) AS out_per_day, round(sum(coalesce(a.e, 0) - coalesce(b.e, 0)) OVER (PARTITION BY route_id, direction ORDER BY seq) / days, 4) AS on_board FROM pl LEFT JOIN a USING (route_id, direction, stop_id) LEFT JOIN b USING (route_id, direction, stop_id) JOIN d USING (route_id)",
    "an_od_matrix": BASE + _RIDES + ", g AS (SELECT entry_stop_id, exit_stop_id, route_id, route_type, direction, entry_period, day_class, day_type, count(*) AS journeys, round(sum(factor), 3) AS est, count(DISTINCT service_date) AS days FROM ride GROUP BY ALL) SELECT g.*, a.stop_name AS entry_stop, b.stop_name AS exit_stop FROM g LEFT JOIN stops a ON a.stop_id = entry_stop_id LEFT JOIN stops b ON b.stop_id = exit_stop_id",
    "an_peak_period_summary": BASE + _DAYS + ", c AS (SELECT day_class, period, count(*) AS trips, count(*) FILTER (WHERE ran) AS operated, count(boardings) AS measured, sum(boardings) AS b, avg(occupancy) AS o, count(peak) AS judged, avg(peak::INT) AS k FROM t GROUP BY ALL), e AS (SELECT c.*, days, (b * operated) / nullif(measured * days, 0) AS per_day FROM c JOIN n_class USING (day_class)) SELECT day_class, period, days, trips, measured, judged, round(b / nullif(measured, 0), 4) AS per_trip, round(per_day, 4) AS per_day, round(per_day / sum(per_day) OVER (PARTITION BY day_class), 4) AS share_of_day, round(o, 4) AS occupancy, round(k, 4) AS peak_rate, round(k, 4) >= 0.5 AS is_peak FROM e",
    "an_stop_hours": BASE + _DAYS + _RIDES + ", h AS (SELECT entry_stop_id AS stop_id, day_class, entry_h AS h, count(*) AS taps, sum(factor) AS e FROM ride WHERE entry_h IS NOT NULL GROUP BY ALL), d AS (SELECT h.*, round(e / days, 4) AS per_day FROM h JOIN n_class USING (day_class)), z AS (SELECT *, round((per_day - avg(per_day) OVER w) / nullif(stddev(per_day) OVER w, 0), 3) AS z FROM d WINDOW w AS (PARTITION BY stop_id, day_class)) SELECT stop_id, day_class, h, taps, per_day, z, coalesce(z >= 1.5, false) AS is_peak FROM z",
    "an_persistent_overcrowding": BASE + _PERSISTENT + " SELECT * FROM persistent",
    "an_underutilized": BASE + _SUPPLY + f", c AS (SELECT *, operated / (days * {_HOURS}) AS an_hour, round(per_trip / nullif(distance_km, 0), 6) AS per_km FROM su), m AS (SELECT period, quantile_disc(per_km, 0.5) AS middle FROM c GROUP BY 1) SELECT route_id, direction, day_class, period, distance_km, days, operated, measured, CASE WHEN measured < 5 THEN 'unknown' WHEN occupancy < 0.3 AND p90 < 0.5 AND per_km < middle AND an_hour >= 0.1 THEN 'underused' WHEN occupancy < 0.3 AND p90 < 0.5 AND per_km < middle THEN 'rare_and_empty' ELSE 'used' END AS state, round(an_hour, 4) AS an_hour, round(occupancy, 4) AS occupancy, round(p90, 4) AS p90, round(per_trip, 4) AS per_trip, per_km, middle FROM c JOIN m USING (period)",
    "an_service_frequency": BASE + _SUPPLY + f", c AS (SELECT *, trips / (days * {_HOURS}) AS an_hour FROM su) SELECT route_id, direction, day_class, period, days, trips, operated, measured, CASE WHEN measured < 5 THEN 'unknown' WHEN round(occupancy, 6) >= 0.85 OR round(overload, 6) >= 0.2 THEN 'too_little' WHEN occupancy < 0.3 AND p90 < 0.5 AND an_hour >= 0.1 THEN 'too_much' ELSE 'matched' END AS state, round(an_hour, 4) AS an_hour, round(per_trip, 4) AS per_trip, round(occupancy, 4) AS occupancy, round(p90, 4) AS p90, round(overload, 4) AS overload, round(peak_rate, 4) AS peak_rate, round(arrival_late, 4) AS arrival_late FROM c",
    "an_demand_supply_gap": BASE + f""",
ty AS (SELECT vehicle_type, max(capacity_total) AS size FROM vehicles WHERE capacity_total IS NOT NULL GROUP BY 1),
c AS (
  SELECT route_id, direction, day_class, period, count(DISTINCT service_date) AS days, count(*) AS operated, count(max_load) AS measured, avg(capacity) AS have, sum(max_load) FILTER (WHERE capacity IS NOT NULL) AS loads, sum(capacity) FILTER (WHERE max_load IS NOT NULL) AS seats, quantile_disc(max_load, 0.9) AS p90_load, avg(denied) AS denied
  FROM t WHERE ran GROUP BY ALL),
g AS (SELECT *, operated / (days * {_HOURS}) AS an_hour, loads / nullif(seats, 0) AS utilisation, p90_load / 0.85 AS need FROM c),
fit AS (SELECT route_id, direction, day_class, period, arg_min(vehicle_type, (ty.size, vehicle_type)) AS fits, min(ty.size) AS size FROM g JOIN ty ON ty.size >= g.need GROUP BY ALL),
s AS (SELECT g.*, fits, size, CASE WHEN measured < 5 OR utilisation IS NULL THEN 'unknown' WHEN round(utilisation, 6) >= 0.9 OR round(denied, 6) >= 1 THEN 'excess_demand' WHEN round(utilisation, 6) < 0.3 THEN 'excess_supply' ELSE 'balanced' END AS gap
  FROM g LEFT JOIN fit ON fit.route_id = g.route_id AND fit.direction IS NOT DISTINCT FROM g.direction AND fit.day_class = g.day_class AND fit.period IS NOT DISTINCT FROM g.period)
SELECT route_id, direction, day_class, period, days, operated, measured, p90_load, fits, size, gap,
  CASE WHEN gap = 'excess_demand' AND size > have THEN 'larger' WHEN gap = 'excess_demand' THEN 'add_trips' WHEN gap = 'excess_supply' AND size < have THEN 'smaller' WHEN gap = 'excess_supply' THEN 'fewer_trips' ELSE 'keep' END AS suggestion,
  round(CASE WHEN gap = 'excess_demand' AND NOT coalesce(size > have, false) THEN greatest(0, ceil(round(an_hour * p90_load / (0.85 * (SELECT max(size) FROM ty)), 6)) - an_hour) END, 4) AS extra_trips,
  round(an_hour, 4) AS an_hour, round(have, 4) AS have, round(utilisation, 4) AS utilisation, round(denied, 4) AS denied, round(need, 4) AS need FROM s""",
    "an_route_performance": BASE + _PERFORMANCE,
    "an_delay_by_stop": BASE + _PLACES + _BY_STOP + " SELECT *, coalesce(place >= 0.95 AND congestion >= 3, false) AS bottleneck FROM by_stop",
    "an_delay_position": BASE + _PLACES + _RECORDS + " SELECT route_type, period, least(9, 10 * (seq - 1) // greatest(stops - 1, 1))::INT AS decile, count(*) AS records, round(avg(delay_minutes), 6) AS mean_delay FROM rec JOIN pl USING (route_id, direction, stop_id) GROUP BY ALL",
    "an_stop_performance": BASE + _DAYS + _RIDES + _USAGE + _PATTERNS + _BY_STOP + """,
w AS (SELECT stop_id, round(sum(in_per_day) FILTER (WHERE period = 'am_peak'), 6) AS am_peak, round(sum(in_per_day) FILTER (WHERE period = 'midday'), 6) AS midday, round(sum(in_per_day) FILTER (WHERE period = 'pm_peak'), 6) AS pm_peak, round(sum(in_per_day) FILTER (WHERE period IN ('early', 'evening')), 6) AS offpeak FROM patterns WHERE day_class = 'weekday' GROUP BY 1),
x AS (SELECT u.stop_id, u.stop_name, u.zone, in_per_day, out_per_day, turnover, usage_rank, routes, records, mean_delay, record_rate, congestion_rate, main_reason, coalesce(place >= 0.95 AND congestion >= 3, false) AS bottleneck, round(served / (SELECT days FROM n_all), 4) AS served_per_day, am_peak, midday, pm_peak, offpeak
  FROM usage u LEFT JOIN by_stop USING (stop_id) LEFT JOIN w USING (stop_id))
SELECT *, round(turnover / nullif(served_per_day, 0), 3) AS per_served FROM x""",
    "an_schedule_adherence": BASE + _HEADWAY + """,
a AS (SELECT route_id, day_class, count(*) AS trips, count(*) FILTER (WHERE trip_status = 'cancelled') AS missed, count(arrival_s) AS arrived, count(*) FILTER (WHERE arrival_s <= -120) AS early, count(*) FILTER (WHERE arrival_s > -120 AND arrival_s < 300) AS on_time, count(*) FILTER (WHERE arrival_s >= 300) AS late FROM t GROUP BY ALL),
i AS (SELECT route_id, day_class, count(*) AS intervals, count(*) FILTER (WHERE state IN ('bunched', 'gap')) AS irregular FROM hw WHERE state <> 'not_judged' GROUP BY ALL)
SELECT *, round(early / nullif(arrived, 0), 4) AS early_share, round(on_time / nullif(arrived, 0), 4) AS on_time_share, round(late / nullif(arrived, 0), 4) AS late_share, round(missed / trips, 4) AS missed_share, round(irregular / nullif(intervals, 0), 4) AS irregular_share FROM a LEFT JOIN i USING (route_id, day_class)""",
    "an_anomalies": BASE + _ANOMALIES + " SELECT kind, entity_type, entity, service_date, observed::DOUBLE AS observed, expected::DOUBLE AS expected, detail FROM anomalies",
    "an_anomaly_summary": BASE + _ANOMALIES + " SELECT kind, count(*) AS signals, count(DISTINCT entity) AS entities, count(DISTINCT service_date) AS days FROM anomalies GROUP BY 1",
    "an_passenger_segments": BASE + _SEGMENTS + " SELECT * FROM segments",
    "an_segment_summary": BASE + _SEGMENTS + """,
c AS (SELECT segment, arg_min(category, (-n, category)) AS main_category FROM (SELECT segment, category, count(*) AS n FROM segments WHERE category IS NOT NULL GROUP BY ALL) GROUP BY 1),
g AS (SELECT segment, count(*) AS passengers, round(avg(rides), 8) AS rides, round(avg(a_week), 8) AS a_week, round(avg(peak), 8) AS peak, round(avg(km), 8) AS km, round(sum(stands_for), 2) AS stands_for FROM segments GROUP BY 1)
SELECT g.*, round(passengers / sum(passengers) OVER (), 4) AS part, round(stands_for / sum(stands_for) OVER (), 4) AS part_of_journeys, main_category FROM g LEFT JOIN c USING (segment)""",
}
