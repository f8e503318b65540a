"""SQL twins of the queries p1_ to p6_, for DuckDB over the same tables."""

_P1 = """
WITH t AS (SELECT DISTINCT * FROM trips), s AS (SELECT DISTINCT * FROM schedules), v AS (SELECT DISTINCT * FROM vehicles),
n AS (SELECT * FROM t SEMI JOIN v USING (vehicle_id) WHERE vehicle_id <> ''),
last AS (SELECT vehicle_id, arg_max(version_id, (effective_from, recorded_at, version_id)) AS last_version FROM v GROUP BY 1),
sched AS (
  SELECT n.trip_id, arg_max(c.schedule_id, (c.valid_from, c.schedule_id)) AS schedule_in_force
  FROM n JOIN s ON s.schedule_id = n.schedule_id
  JOIN s c ON c.route_id IS NOT DISTINCT FROM s.route_id AND c.service_id IS NOT DISTINCT FROM s.service_id
    AND c.direction IS NOT DISTINCT FROM s.direction AND c.period IS NOT DISTINCT FROM s.period
    AND c.valid_from <= n.service_date AND (c.valid_to IS NULL OR n.service_date <= c.valid_to)
  GROUP BY 1),
vers AS (
  SELECT n.trip_id, arg_max(v.version_id, (v.effective_from, v.recorded_at, v.version_id)) AS version_in_force
  FROM n JOIN v ON v.vehicle_id = n.vehicle_id AND v.effective_from <= n.service_date AND v.recorded_at <= n.scheduled_departure
  GROUP BY 1)
SELECT n.trip_id, coalesce(schedule_in_force, '') AS schedule_id, coalesce(version_in_force, 0) AS version_id
FROM n JOIN last USING (vehicle_id) LEFT JOIN sched USING (trip_id) LEFT JOIN vers USING (trip_id)
WHERE n.schedule_id IN (SELECT schedule_id FROM s) AND n.schedule_id <> ''
  AND (schedule_in_force IS DISTINCT FROM n.schedule_id OR version_in_force IS DISTINCT FROM last_version)
"""

_P1_ATTRIBUTES = """
WITH t AS (SELECT DISTINCT * FROM trips), s AS (SELECT DISTINCT * FROM schedules), v AS (SELECT DISTINCT * FROM vehicles),
sched AS (
  SELECT t.trip_id, arg_max(c.schedule_id, (c.valid_from, c.schedule_id)) AS schedule_in_force
  FROM t JOIN s ON s.schedule_id = t.schedule_id AND s.schedule_id <> ''
  JOIN s c ON c.route_id IS NOT DISTINCT FROM s.route_id AND c.service_id IS NOT DISTINCT FROM s.service_id
    AND c.direction IS NOT DISTINCT FROM s.direction AND c.period IS NOT DISTINCT FROM s.period
    AND c.valid_from <= t.service_date AND (c.valid_to IS NULL OR t.service_date <= c.valid_to)
  GROUP BY 1),
vers AS (
  SELECT t.trip_id, arg_max(v.version_id, (v.effective_from, v.recorded_at, v.version_id)) AS version_in_force
  FROM t JOIN v ON v.vehicle_id = t.vehicle_id AND v.vehicle_id <> '' AND v.effective_from <= t.service_date AND v.recorded_at <= t.scheduled_departure
  GROUP BY 1)
SELECT t.trip_id, t.service_date, t.scheduled_departure, schedule_in_force, version_in_force, v.capacity_total
FROM t LEFT JOIN sched USING (trip_id) LEFT JOIN vers USING (trip_id) LEFT JOIN v ON v.version_id = vers.version_in_force
"""

_LINES = """
WITH r AS (SELECT DISTINCT * FROM raw_records),
f AS (
  SELECT record_id, table_name, CASE table_name WHEN 'delays' THEN 12 WHEN 'tickets' THEN 13 ELSE 11 END AS width,
    CASE table_name WHEN 'delays' THEN 10 WHEN 'tickets' THEN 8 ELSE 6 END AS tested,
    regexp_full_match(raw_line, '([^",]*|"([^"]|"")*")(,([^",]*|"([^"]|"")*"))*') AS sound,
    regexp_extract_all(',' || raw_line, ',("(?:[^"]|"")*"|[^",]*)', 1) AS fields
  FROM r),
x AS (
  SELECT *, CASE WHEN fields[tested] LIKE '"%' THEN replace(substr(fields[tested], 2, length(fields[tested]) - 2), '""', '"') ELSE fields[tested] END AS v
  FROM f),
e AS (
  SELECT *, CASE WHEN NOT sound THEN 'quoting' WHEN len(fields) <> width THEN 'columns'
    WHEN v = '' THEN NULL
    WHEN table_name = 'delays' AND NOT regexp_full_match(v, '[+-]?[0-9]+(\\.[0-9]+)?') THEN 'value'
    WHEN table_name = 'passenger_counts' AND (NOT regexp_full_match(v, '[+-]?[0-9]+') OR try_cast(v AS INTEGER) IS NULL) THEN 'value'
    WHEN table_name = 'tickets' AND (NOT regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}') OR try_strptime(v, '%Y-%m-%d %H:%M:%S') IS NULL) THEN 'value' END AS reason
  FROM x)
"""

_DAILY = """
WITH daily AS (
  SELECT route_id, service_date, arg_max_null(boardings, (loaded_at, boardings)) AS boardings
  FROM route_daily_boardings WHERE route_id <> '' AND service_date IS NOT NULL GROUP BY ALL),
span AS (SELECT route_id, min(service_date) AS a, max(service_date) AS b FROM daily GROUP BY 1),
dense AS (SELECT route_id, a, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS service_date FROM span),
x AS (
  SELECT d.route_id, d.service_date, a, boardings,
    sum(coalesce(boardings, 0)) OVER w7 AS total_7, sum(coalesce(boardings, 0)) OVER w30 AS total_30
  FROM dense d LEFT JOIN daily USING (route_id, service_date)
  WINDOW w7 AS (PARTITION BY d.route_id ORDER BY d.service_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
    w30 AS (PARTITION BY d.route_id ORDER BY d.service_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
"""

_REFS = """
WITH p AS (
  SELECT 'trips' AS parent, trip_id AS key, min(received_at) AS first_seen FROM trips GROUP BY ALL
  UNION ALL SELECT 'stops', stop_id, NULL FROM stops GROUP BY ALL
  UNION ALL SELECT 'vehicles', vehicle_id, min(recorded_at) FROM vehicles GROUP BY ALL),
g AS (SELECT table_name AS parent, record_key AS key, min(deleted_at) AS gone_at FROM tombstones GROUP BY ALL),
r AS (
  SELECT 'tickets' AS table_name, 'trip_id' AS field_name, ticket_id AS record_key, strftime(service_date, '%Y-%m') AS period, 'trips' AS parent, trip_id AS key, received_at AS seen FROM tickets
  UNION SELECT 'tickets', 'entry_stop_id', ticket_id, strftime(service_date, '%Y-%m'), 'stops', entry_stop_id, received_at FROM tickets
  UNION SELECT 'passenger_counts', 'vehicle_id', count_id, strftime(service_date, '%Y-%m'), 'vehicles', vehicle_id, received_at FROM passenger_counts
  UNION SELECT 'routes', 'origin_stop_id', route_id, strftime(launch_date, '%Y-%m'), 'stops', origin_stop_id, NULL FROM routes),
found AS (
  SELECT DISTINCT table_name, field_name, record_key, period,
    CASE WHEN gone_at IS NOT NULL AND (seen IS NULL OR gone_at <= seen) THEN 'deleted' WHEN p.key IS NULL THEN 'missing' WHEN first_seen > seen THEN 'late' END AS reason
  FROM r LEFT JOIN p USING (parent, key) LEFT JOIN g USING (parent, key) WHERE key <> '')
"""

_P5 = """
WITH s AS (SELECT DISTINCT * FROM schedules WHERE route_id <> '' AND valid_from IS NOT NULL),
i AS (
  SELECT 'days' AS axis, route_id, service_id, direction, period AS sub_key, schedule_id, date_diff('day', DATE '1970-01-01', valid_from) AS lo,
    coalesce(date_diff('day', DATE '1970-01-01', valid_to) + 1, 10000000) AS hi FROM s
  UNION SELECT 'clock', route_id, service_id, direction, strftime(valid_from, '%Y-%m-%d'), schedule_id,
    start_time[1:2]::INT * 60 + start_time[4:5]::INT AS lo,
    end_time[1:2]::INT * 60 + end_time[4:5]::INT + CASE WHEN end_time <= start_time THEN 1440 ELSE 0 END FROM s WHERE start_time IS NOT NULL AND end_time IS NOT NULL),
v AS (SELECT * FROM i WHERE hi > lo),
o AS (SELECT *, max(hi) OVER (PARTITION BY axis, route_id, service_id, direction, sub_key ORDER BY lo, hi, schedule_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
m AS (SELECT *, sum(CASE WHEN reach >= lo THEN 0 ELSE 1 END) OVER (PARTITION BY axis, route_id, service_id, direction, sub_key ORDER BY lo, hi, schedule_id) AS run FROM o),
p AS (SELECT axis, route_id, service_id, direction, sub_key, run, min(lo) AS lo, max(hi) AS hi FROM m GROUP BY ALL),
shared AS (
  SELECT DISTINCT a.axis, a.route_id, a.service_id, a.direction, a.sub_key, a.run FROM m a JOIN m b
  ON (a.axis, a.route_id, a.service_id, a.direction, a.sub_key, a.run) IS NOT DISTINCT FROM (b.axis, b.route_id, b.service_id, b.direction, b.sub_key, b.run)
    AND a.schedule_id < b.schedule_id AND a.lo < b.hi AND b.lo < a.hi),
c AS (
  SELECT p.*, 'merged' AS kind FROM p SEMI JOIN shared USING (axis, route_id, service_id, direction, sub_key, run)
  UNION ALL SELECT axis, route_id, service_id, direction, sub_key, run, hi, next_lo, 'gap' FROM (
    SELECT *, lead(lo) OVER (PARTITION BY axis, route_id, service_id, direction, sub_key ORDER BY lo) AS next_lo FROM p) WHERE next_lo IS NOT NULL)
SELECT axis, route_id, service_id, direction, sub_key, kind,
  CASE axis WHEN 'days' THEN strftime(DATE '1970-01-01' + lo::INT, '%Y-%m-%d') ELSE format('{:02d}:{:02d}', lo % 1440 // 60, lo % 60) END AS from_key,
  CASE WHEN axis = 'clock' THEN format('{:02d}:{:02d}', hi % 1440 // 60, hi % 60) WHEN hi = 10000000 THEN '' ELSE strftime(DATE '1970-01-01' + (hi - 1)::INT, '%Y-%m-%d') END AS to_key
FROM c
"""

_P6 = """
WITH r AS (
  SELECT DISTINCT 'passenger_counts' AS measure, vehicle_id AS source, service_date::TIMESTAMP AS t, count_id AS id, max_load::DOUBLE AS value FROM passenger_counts
  UNION SELECT 'gps_events', vehicle_id, event_time, event_id, speed_kmh FROM gps_events
  UNION SELECT 'delays', route_id, scheduled_arrival, delay_id, delay_minutes FROM delays),
x AS (SELECT * FROM r WHERE value IS NOT NULL AND source <> ''),
a AS (SELECT measure, source, median(value) AS level, count(*) AS n FROM x WHERE value <> 0 GROUP BY ALL),
u AS (SELECT measure, source, quantile_cont(abs(value - level), 0.6827) AS spread FROM x JOIN a USING (measure, source) WHERE value <> 0 GROUP BY ALL),
o AS (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY measure, source ORDER BY t, id) AND value <> 0 THEN 0 ELSE 1 END AS start FROM x),
k AS (SELECT *, sum(start) OVER (PARTITION BY measure, source ORDER BY t, id) AS run FROM o),
l AS (SELECT *, count(*) OVER (PARTITION BY measure, source, run) AS length FROM k),
f AS (
  SELECT measure, source, id, 'impossible' AS kind FROM x WHERE CASE measure WHEN 'passenger_counts' THEN value NOT BETWEEN 0 AND 400 WHEN 'gps_events' THEN value NOT BETWEEN 0 AND 150 ELSE value NOT BETWEEN -60 AND 600 END
  UNION SELECT measure, source, id, 'spike' FROM x JOIN a USING (measure, source) JOIN u USING (measure, source) WHERE n >= 40 AND value <> 0 AND abs(value - level) > 8 * spread
  UNION SELECT measure, source, id, 'stuck' FROM l WHERE length >= 8 AND value <> 0)
"""

SQL = {
    "p1_found": _P1,
    "p1_attributes": _P1_ATTRIBUTES,
    "p2_found": _LINES + "SELECT record_id, reason FROM e WHERE reason IS NOT NULL",
    "p2_failures": _LINES + "SELECT table_name, reason, count(*) AS n FROM e WHERE reason IS NOT NULL GROUP BY ALL",
    "p3_found": _DAILY + "SELECT route_id, strftime(service_date, '%Y-%m-%d') AS service_date, total_7::BIGINT AS total_7, total_30::BIGINT AS total_30 FROM x WHERE boardings IS NULL",
    "p3_rolling": _DAILY + "SELECT route_id, service_date, boardings, total_7::BIGINT AS total_7, total_30::BIGINT AS total_30, round(total_7 / least(7, service_date - a + 1), 6) AS avg_7, round(total_30 / least(30, service_date - a + 1), 6) AS avg_30 FROM x",
    "p4_found": _REFS + "SELECT * FROM found WHERE reason IS NOT NULL",
    "p4_report": _REFS + "SELECT table_name, field_name, period, reason, count(*) AS n FROM found WHERE reason IS NOT NULL GROUP BY ALL",
    "p5_found": _P5,
    "p6_found": _P6 + "SELECT DISTINCT measure AS table_name, id AS record_key FROM f",
    "p6_kinds": _P6 + "SELECT measure, kind, count(*) AS n, count(DISTINCT source) AS sources FROM f GROUP BY ALL",
}

_DUCK = {"string": "VARCHAR", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "double": "DOUBLE", "int": "INTEGER"}


def typed_sql(name: str, columns: tuple[str, ...], types: list[str]) -> str:
    """The valid rows of one table: fields without their quotes, '' as null, what does not fit as null."""
    def field(i: int, kind: str) -> str:
        f = f"fields[{i + 1}]"
        bare = f"CASE WHEN {f} LIKE '\"%' THEN replace(substr({f}, 2, length({f}) - 2), '\"\"', '\"') ELSE {f} END"
        return f"TRY_CAST(nullif({bare}, '') AS {_DUCK[kind]})"

    picked = ", ".join(f"{field(i, t)} AS {c}" for i, (c, t) in enumerate(zip(columns, types)))
    return _LINES + f"SELECT record_id, {picked} FROM e WHERE reason IS NULL AND table_name = '{name}'"
