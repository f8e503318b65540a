"""A database in the driver's process, in a local session and on a cluster."""

import datetime as dt
import os
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import pytest

from fareline.plans import decisions
from fareline.plans.decisions import embedded_database, read_embedded, write_embedded

ROOT, DATA = Path(__file__).resolve().parents[1], Path("/root/testdata/sf0.001")
ON_A_CLUSTER = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.executor.memory", "600m").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
print("rows", sorted(map(tuple, entry.queries()["io_database"](spark, sys.argv[1]).collect())))
"""


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_database_query_on_a_cluster(spark, tmp_path):
    done = subprocess.run([sys.executable, "-c", ON_A_CLUSTER, str(DATA), f"file://{tmp_path}"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=300)
    expected = spark.read.parquet(f"{DATA}/routes.parquet").where("route_id != ''").select("route_id", "distance_km", "base_fare").collect()
    assert f"rows {sorted(map(tuple, expected))}\n" in done.stdout, done.stderr[-2000:]


def test_rows_of_all_parts_and_types_come_back(spark, rows, monkeypatch):
    monkeypatch.setattr(decisions, "EMBEDDED_ROWS", 3)
    day, at = dt.date(2024, 2, 29), dt.datetime(2024, 2, 29, 23, 59, 58, 120000)
    data = [(i, f"a'{i}", i / 3, day, at, Decimal("1.25"), i % 2 == 0) for i in range(20)] + [(20, None, None, None, None, None, None)]
    df = spark.createDataFrame(data, "id int, name string, x double, d date, at timestamp, price decimal(10,2), flag boolean").repartition(4)
    with embedded_database(spark) as (url, properties):
        write_embedded(df, url, "t", properties)
        write_embedded(df, url, "t", properties)  # replaces them
        assert rows(read_embedded(spark, url, "t", properties)) == sorted(data, key=repr)
        write_embedded(df.where("id < 0"), url, "t", properties)
        found = read_embedded(spark, url, "t", properties)
    assert found.columns == df.columns and found.collect() == []
