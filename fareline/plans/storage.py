"""Scans and sinks as queries: tables are written to the shared folder in some format and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareline.operators import quality as Q
from fareline.plans.decisions import embedded_database, read_embedded, write_embedded
from fareline.plans.templates import Project, band_case
from fareline.session import scratch, table
from fareline.sources import readers as R
from fareline.sources.recovery import parse_texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


DELAYS = T.StructType([T.StructField(n, t()) for n, t in (("delay_id", T.StringType), ("trip_id", T.StringType), ("service_date", T.DateType), ("scheduled_arrival", T.TimestampNTZType), ("delay_minutes", T.DoubleType))])


def _texts(delays: DataFrame) -> DataFrame:
    """Delays as texts, some spoilt by rule: ids on 7 have no number, ids on 31 another form of the date."""
    d = delays.select("delay_id", "trip_id", "service_date", "scheduled_arrival", "delay_minutes").where("delay_id is not null").distinct()
    day = F.when(F.col("delay_id").endswith("31"), F.date_format("service_date", "dd.MM.yyyy")).otherwise(F.date_format("service_date", "yyyy-MM-dd"))
    minutes = F.when(F.col("delay_id").endswith("7"), F.lit("n/a")).otherwise(F.col("delay_minutes").cast("string"))
    return d.select("delay_id", "trip_id", day.alias("service_date"), F.date_format("scheduled_arrival", "yyyy-MM-dd HH:mm:ss").alias("scheduled_arrival"), minutes.alias("delay_minutes"))


def _scanned(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    path, rows = scratch(spark), _texts(table(spark, sf_dir, "delays"))
    if fmt == "csv":
        rows.write.option("header", True).csv(path)
    else:  # numbers as numbers, what is no number as a text
        others = [c for c in rows.columns if c != "delay_minutes"]
        number = F.col("delay_minutes").try_cast("double").alias("delay_minutes")
        rows.select(F.when(F.col("delay_minutes") == "n/a", F.to_json(F.struct(*rows.columns))).otherwise(F.to_json(F.struct(*others, number))).alias("value")).write.text(path)
    return R.typed_scan(spark, path, DELAYS, fmt)


_SPOILT = "(SELECT DISTINCT delay_id, trip_id, service_date, scheduled_arrival, delay_minutes FROM delays WHERE delay_id IS NOT NULL)"
_BAD = "delay_id LIKE '%7' OR (delay_id LIKE '%31' AND service_date IS NOT NULL)"
_CASES = f"SELECT delay_id, CASE WHEN delay_id LIKE '%7' THEN 'delay_minutes' ELSE 'service_date' END AS failed_columns, 'value' AS reason FROM {_SPOILT} WHERE {_BAD}"


def _quarantined(fmt: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return R.quarantine(_scanned(spark, sf_dir, fmt), DELAYS, fmt).select(F.get("values", F.lit(0)).alias("delay_id"), "failed_columns", "reason")

    return run


QUERIES |= {"io_csv_quarantine": _quarantined("csv"), "io_json_quarantine": _quarantined("json")}
SQL |= {"io_csv_quarantine": _CASES, "io_json_quarantine": _CASES}


@query(f"SELECT delay_id, trip_id, service_date, scheduled_arrival, delay_minutes FROM {_SPOILT} WHERE NOT ({_BAD})")
def io_csv_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.accepted(_scanned(spark, sf_dir, "csv")).drop("_source_file")


@query(f"SELECT delay_id, service_date, scheduled_arrival, 0e0 AS delay_minutes FROM {_SPOILT} WHERE delay_id LIKE '%7'")
def io_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarantined rows of which only the number failed, with a correction in its place."""
    bad = R.quarantine(_scanned(spark, sf_dir, "csv"), DELAYS)
    return R.recovered(bad, DELAYS, ["delay_minutes"], {"delay_minutes": F.lit(0.0)}).select("delay_id", "service_date", "scheduled_arrival", "delay_minutes")


@query(f"SELECT count(*) AS records, count(*) AS rows FROM {_SPOILT}")
def io_raw_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records counted as lines against rows of the typed scan, corrupt ones included."""
    path = scratch(spark)
    _texts(table(spark, sf_dir, "delays")).write.option("header", True).csv(path)
    raw, scanned = R.raw_record_count(spark, path), R.rows_per_file(R.typed_scan(spark, path, DELAYS))
    return raw.select("records", scanned.agg(F.sum("rows")).scalar().alias("rows"))


@query("SELECT 1 AS files, count(*)::BIGINT AS records FROM stops")
def io_json_array_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One array with the stops (a table of fixed size), counted by its elements."""
    path = scratch(spark)
    table(spark, sf_dir, "stops").agg(F.to_json(F.collect_list(F.struct("stop_id", "stop_name"))).alias("value")).coalesce(1).write.text(path)
    n = R.raw_record_count(spark, path, "json")
    return n.select(F.col("files").cast("int").alias("files"), "records")


@query("SELECT stop_id, stop_name FROM stops")
def io_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    table(spark, sf_dir, "stops").agg(F.to_json(F.collect_list(F.struct("stop_id", "stop_name"))).alias("value")).coalesce(1).write.text(path)
    return R.typed_scan(spark, path, "stop_id string, stop_name string", "json", multiline=True).select("stop_id", "stop_name")


def _partitioned(fmt: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = table(spark, sf_dir, "trips").select("trip_id", "direction", F.date_format("service_date", "yyyy-MM").alias("ym"))
        back = R.write_partitioned(t, scratch(spark), "ym", fmt)
        return back.where("ym between '2024-03' and '2024-05'").groupBy(F.col("ym").cast("string").alias("ym")).agg(F.count(F.lit(1)).alias("n"), F.sum("direction").alias("directions"))

    return run


for _fmt in ("parquet", "orc"):
    QUERIES[f"io_partitioned_{_fmt}"] = _partitioned(_fmt)
    SQL[f"io_partitioned_{_fmt}"] = "SELECT strftime(service_date, '%Y-%m') AS ym, count(*) AS n, sum(direction)::BIGINT AS directions FROM trips WHERE strftime(service_date, '%Y-%m') BETWEEN '2024-03' AND '2024-05' GROUP BY 1"


@query("SELECT count(*) AS rows, 3::BIGINT AS files FROM trips")
def io_counted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written to three files, counted as they are read back."""
    back, _ = R.write_counted(table(spark, sf_dir, "trips"), scratch(spark), 3)
    return back.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(F.col("_metadata.file_path")).alias("files"))


@query('SELECT "table", 2 * count(*) AS n FROM (SELECT \'trips\' AS "table" FROM trips UNION ALL SELECT \'delays\' FROM delays) GROUP BY 1')
def io_append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("table"), F.col(k).alias("key")) for t, k in (("trips", "trip_id"), ("delays", "delay_id"))]
    for _ in range(2):
        R.append_log(parts[0].unionByName(parts[1]), path)
    return spark.read.parquet(path).groupBy(F.col("table").cast("string").alias("table")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT rule_id, count(*) AS n FROM (SELECT 'R04' AS rule_id FROM passenger_counts WHERE boardings < 0 UNION ALL SELECT 'R06' FROM passenger_counts WHERE max_load > 400) GROUP BY 1")
def io_rule_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations in a directory per rule, found again by their directories."""
    path = scratch(spark)
    c = Q.Catalog({"passenger_counts": table(spark, sf_dir, "passenger_counts")}, {"passenger_counts": ["count_id"]})
    rules = [Q.Rule("R04", "non_negative", "passenger_counts", params={"columns": ["boardings"]}), Q.Rule("R06", "value_range", "passenger_counts", params={"column": "max_load", "high": 400})]
    R.write_per_value(Q.run_rules(c, rules), path, "rule_id")
    return spark.read.parquet(path).groupBy(F.col("rule_id").cast("string").alias("rule_id")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT route_id, distance_km FROM routes WHERE distance_km > 10")
def io_csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    R.export_csv(table(spark, sf_dir, "routes").where("distance_km > 10").select("route_id", "distance_km"), path, ["route_id"])
    back = R.all_strings(spark, path, ["route_id", "distance_km"])
    return back.select("route_id", F.col("distance_km").cast("double").alias("distance_km"))


@query("SELECT 'missing: depot' AS drift UNION ALL SELECT 'new: distance_km' UNION ALL SELECT 'type of base_fare: double instead of int'")
def io_schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    table(spark, sf_dir, "routes").select("route_id", "base_fare", "distance_km").write.option("header", True).csv(path)
    found = R.schema_drift(T.StructType.fromDDL("route_id string, base_fare int, depot string"), R.inferred(spark, path).schema)
    return spark.createDataFrame([(x,) for x in found], "drift string")


@query("SELECT band, count(*) AS n FROM (SELECT CASE WHEN distance_km < 10 THEN 'short' WHEN distance_km < 20 THEN 'middle' WHEN distance_km IS NOT NULL THEN 'long' END AS band FROM routes WHERE status = 'active') GROUP BY 1")
def io_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that read each other, the last of them from a stored result."""
    table(spark, sf_dir, "routes").createOrReplaceTempView("io_routes")
    texts = {
        "io_counted": "SELECT band, count(*) AS n FROM io_banded GROUP BY band",
        "io_banded": f"SELECT {band_case('distance_km', [(10, 'short'), (20, 'middle'), (None, 'long')])} AS band FROM io_active",
        "io_active": "SELECT * FROM io_routes WHERE status = '{{status}}'",
    }
    return Project(texts, {"status": "active"}, ("io_banded",), scratch(spark)).build(spark, ["io_counted"])["io_counted"]


@query("SELECT route_id, distance_km, base_fare FROM routes WHERE route_id <> ''")
def io_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a database table replaced twice, its definition kept, and read back: in an embedded database of the
    driver's process, so the rows pass through the driver, in a local session and on a cluster alike."""
    rows = table(spark, sf_dir, "routes").where("route_id != ''").select("route_id", "distance_km", "base_fare")
    with embedded_database(spark) as (url, properties):
        for part in (rows.limit(1), rows):
            write_embedded(part, url, "routes", properties)
        return read_embedded(spark, url, "routes", properties)


def p2_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines put together to texts of many records, which the grammar takes apart again: after a broken record it
    resumes at the next validated record start. A row per record, as ``parse_texts`` gives them; texts are blocks of at
    most 1,000 lines of a file, so a file of any size is read in parts."""
    from fareline.plans.problems import CONTRACTS

    lines = table(spark, sf_dir, "raw_records").select("table_name", "file_name", "line_no", "raw_line").distinct().where("raw_line is not null")
    block = lines.groupBy("table_name", "file_name", F.floor(F.col("line_no") / 1000).alias("block"))
    sorted_: Column = F.array_sort(F.collect_list(F.struct("line_no", "raw_line")))
    texts = block.agg(F.array_join(F.transform(sorted_, lambda s: s["raw_line"]), "\n").alias("text"))
    texts = texts.withColumn("part", F.concat_ws("/", "file_name", "block"))
    return parse_texts(texts, CONTRACTS, "part", "table_name", "text").select("part", "table_name", "record_no", "begin", "reason", "detail")


QUERIES["p2_resumed"] = p2_resumed
