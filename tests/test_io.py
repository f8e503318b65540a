import datetime as dt
import json
from graphlib import CycleError

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareline.plans import templates
from fareline.plans.serving import BadRequest, View, filtered, page
from fareline.sources import readers as R
from fareline.streaming import live

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("at", T.TimestampNTZType()), T.StructField("d", T.DateType())])


def test_csv_scan_quarantines_what_does_not_fit(spark, rows, tmp_path):
    (tmp_path / "a.csv").write_text("id,n,at,d\n1,5,2024-01-01 08:00:00,2024-01-01\n2,x,2024-01-01 08:00:00,2024-01-01\n3,,,\n4,7,N/A,2024-13-01\n\n")
    (tmp_path / "b.csv").write_text("id,n,at,d\n5,1,2024-01-02 00:00:00,2024-01-02\n")
    scanned = R.typed_scan(spark, str(tmp_path), SCHEMA).cache()
    good, bad = R.accepted(scanned), R.quarantine(scanned, SCHEMA)
    assert rows(good, "id", "n") == [("1", 5), ("3", None), ("5", 1)]
    assert rows(bad, "failed_columns", "reason") == [("at,d", "value"), ("n", "value")]
    assert rows(R.raw_record_count(spark, str(tmp_path))) == [(2, good.count() + bad.count())]
    assert rows(R.recovered(bad, SCHEMA, ["n"])) == [("2", None, dt.datetime(2024, 1, 1, 8), dt.date(2024, 1, 1))]
    assert sorted(r.rows for r in R.rows_per_file(scanned).collect()) == [1, 4]
    scanned.unpersist()


def test_json_scans(spark, rows, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id": "1", "n": 2}\n{"id": "2", "n": "x"}\n{broken\n')
    scanned = R.typed_scan(spark, str(tmp_path / "l.jsonl"), "id string, n int", "json").cache()
    assert rows(R.accepted(scanned), "id", "n") == [("1", 2)]
    assert scanned.where("_corrupt_record is not null").count() == 2
    (tmp_path / "m.json").write_text(json.dumps([{"id": "a", "ex": [{"d": "2024-01-01"}]}, {"id": "b", "ex": []}]))
    nested = R.typed_scan(spark, str(tmp_path / "m.json"), "id string, ex array<struct<d: date>>", "json", multiline=True)
    assert rows(nested.selectExpr("id", "inline(ex)")) == [("a", dt.date(2024, 1, 1))]


def test_quarantine_names_what_the_scan_could_not_read(spark, rows, tmp_path):
    lines = ["1,5,2024-01-01T08:00:00,2024-01-01", "2,5,2024-01-01 08:00,2024-01-01", "3,5,2024-01-01 08:00:00,2024-1-1", '4,"5,2024-01-01 08:00:00,2024-01-01', "5,5,2024-01-01 08:00:00", '"6","x,y",2024-01-01 08:00:00,2024-01-01', "7,5,2024-01-01 08:00:00,2024-01-01"]
    for i, line in enumerate(lines):
        (tmp_path / f"{i}.csv").write_text(f"id,n,at,d\n{line}\n")
    scanned = R.typed_scan(spark, str(tmp_path), SCHEMA).cache()
    assert rows(R.accepted(scanned), "id") == [("7",)]
    bad = R.quarantine(scanned, SCHEMA)
    assert sorted((r.raw_record[:2].strip('"'), r.failed_columns, r.reason) for r in bad.collect()) == [("1,", "at", "value"), ("2,", "at", "value"), ("3,", "d", "value"), ("4,", "", "quoting"), ("5,", "", "columns"), ("6", "n", "value")]
    fixed = R.recovered(bad, SCHEMA, ["at", "n"], {"at": F.to_timestamp_ntz(F.concat("d", F.lit(" 00:00:00")))})
    midnight = dt.datetime(2024, 1, 1)
    assert rows(fixed, "id", "n", "at") == [("1", 5, midnight), ("2", 5, midnight), ("6", None, dt.datetime(2024, 1, 1, 8))]
    scanned.unpersist()


def test_json_quarantine_and_counts(spark, rows, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id": "1", "n": 2}\n{"id": "2", "n": "x"}\n{broken\n\n')
    schema = T.StructType.fromDDL("id string, n int")
    scanned = R.typed_scan(spark, str(tmp_path / "l.jsonl"), schema, "json").cache()
    assert rows(R.quarantine(scanned, schema, "json"), "failed_columns", "reason") == [("", "structure"), ("n", "value")]
    assert rows(R.raw_record_count(spark, str(tmp_path / "l.jsonl"), "lines")) == [(1, 3)]
    (tmp_path / "a.json").write_text(json.dumps([{"a": 1}, {"a": 2}, {"a": 3}]))
    (tmp_path / "b.json").write_text(json.dumps([]))
    assert rows(R.raw_record_count(spark, str(tmp_path / "*.json"), "json")) == [(2, 3)]


def test_drift(spark):
    assert R.schema_drift(SCHEMA, T.StructType.fromDDL("id string, n bigint, x int, d date")) == ["missing: at", "type of n: bigint instead of int", "new: x"]


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json"])
def test_sinks_read_back(spark, tmp_path, fmt):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, n int")
    back = R.write_partitioned(df, str(tmp_path / fmt), "k", fmt)
    assert back.count() == 3 and (tmp_path / fmt / "k=a").is_dir()
    R.append_log(df.withColumnRenamed("k", "table"), str(tmp_path / "log"))
    R.append_log(df.withColumnRenamed("k", "table"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6
    R.export_csv(df, str(tmp_path / "csv"), ["n"])
    assert R.all_strings(spark, str(tmp_path / "csv"), ["k", "n"]).count() == 3
    assert dict(R.inferred(spark, str(tmp_path / "csv")).dtypes)["n"] == "int"


def test_statements(spark, tmp_path):
    texts = {"counted": "SELECT count(*) AS n FROM small", "small": "SELECT * FROM wide WHERE id < {{top}}", "wide": "SELECT * FROM range(10)", "other": "SELECT * FROM counted"}
    p = templates.Project(texts, {"top": 4}, ("counted",), str(tmp_path))
    assert p.order(["other"]) == ["wide", "small", "counted", "other"] and p.order(["small"]) == ["wide", "small"]
    assert p.build(spark, ["counted"])["counted"].first().n == 4
    again = templates.Project(texts, {"top": 9}, ("counted",), str(tmp_path))
    assert again.build(spark, ["counted"], kept=["counted"])["counted"].first().n == 4
    assert again.build(spark, ["other"])["other"].first().n == 9
    with pytest.raises(KeyError):
        templates.Project(texts).build(spark, ["small"])
    with pytest.raises(CycleError):
        templates.Project({"a": "SELECT * FROM b", "b": "SELECT * FROM a"}).order(["a"])
    assert spark.sql(f"SELECT {templates.band_case('x', [(1, 'a'), (None, 'b')])} FROM VALUES (0), (2), (NULL) t(x)").collect() == [("a",), ("b",), (None,)]


def test_pages(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], None if i == 3 else i % 5, dt.date(2024, 1, 1 + i)) for i in range(10)], "id int, k string, x int, d date")
    view = View(equal=("k",), day="d", either={"any": ("k", "id")}, search=("k",), sortable=("x",), tiebreak=("id",))
    rows, total = page(df, view, {"k": "b", "from": "2024-01-02"}, "-x", 3, 1)
    assert ([r.id for r in rows.collect()], total) == ([7, 1, 5], 5)
    assert filtered(df, view, {"any": "b"}).count() == 5 and filtered(df, view, {"q": "A"}).count() == 5
    for bad in ({"nope": "1"}, {"x": "1"}):
        with pytest.raises(BadRequest):
            page(df, view, bad, "x", 3)
    with pytest.raises(BadRequest):
        page(df, view, {}, "id", 3)


def test_streams(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    for i, minutes in enumerate(([0, 1, 100], [1, 2, 400], [0, 401])):
        spark.createDataFrame([(f"e{m}", "v", t + dt.timedelta(minutes=m), float(m)) for m in minutes], "id string, v string, at timestamp_ntz, x double").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    files = str(tmp_path / "in/*")
    schema = "id string, v string, at timestamp_ntz, x double"
    last = live.run_to_memory(live.latest_positions(live.event_stream(spark, files, schema, 1), "v", "at", ["x"], "60 minutes"), "last")
    assert {r.x for r in last.collect()} >= {2.0}
    unique = live.run_to_memory(live.without_repeats(live.event_stream(spark, files, schema, 9), "id", "at", "2 days"), "unique")
    assert sorted(r.id for r in unique.collect()) == ["e0", "e1", "e100", "e2", "e400", "e401"]
    batch = spark.read.schema(schema).parquet(files).dropDuplicates(["id"])
    assert sorted(r.n for r in live.sessions(batch, "v", "at").collect()) == [1, 2, 3]
    assert sum(r.n for r in live.tumbling_counts(batch, "at", ["v"]).collect()) == 6
    inside, outside = live.split_late(batch.selectExpr("*", "date'2024-01-01' as day"), "at", "day", -1, 1)
    assert (inside.count(), outside.count()) == (6, 0)


def test_latest_positions_of_every_window(spark, tmp_path):
    from fareline.plans.catalog import QUERIES

    t = dt.datetime(2024, 1, 1)
    events = [("a", "v", t, "stop"), ("b", "v", t + dt.timedelta(seconds=9), "move"), ("d", "w", t, "stop"), ("c", "w", t, "move"), ("e", "x", t, "stop")]
    spark.createDataFrame(events, "event_id string, vehicle_id string, event_time timestamp_ntz, event_type string").write.parquet(str(tmp_path / "gps_events.parquet"))
    last = QUERIES["stream_latest_positions"](spark, str(tmp_path))
    assert sorted((r.vehicle_id, r.event_type) for r in last.collect()) == [("v", "move"), ("w", "stop"), ("x", "stop")]


def test_reports(spark):
    from fareline.plans.decisions import to_json_report, to_markdown

    df = spark.createDataFrame([(1, "a|b"), (2, None), (3, "c")], "n int, k string").orderBy("n")
    assert to_markdown(df).splitlines() == ["| n | k |", "|---|---|", "| 1 | a\\|b |", "| 2 |  |", "| 3 | c |"]
    assert to_markdown(df, 1).splitlines()[-1] == "2 more rows"
    assert json.loads(to_json_report({"s": df}, 1)) == {"s": {"rows": 3, "first": [{"n": 1, "k": "a|b"}]}}
