"""Every query with an SQL twin, run by both engines on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    db = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    mine = entry.queries()[name](spark, str(DATA)).toArrow()
    duck.register("mine", mine)
    columns = ", ".join(f'"{c}"' for c in sorted(mine.column_names))
    twin = f"SELECT {columns} FROM ({entry.oracle_sql()[name]})"
    for a, b in ((f"SELECT {columns} FROM mine", twin), (twin, f"SELECT {columns} FROM mine")):
        assert duck.execute(f"SELECT * FROM ({a}) EXCEPT ALL SELECT * FROM ({b})").fetchall()[:3] == []


def test_every_query_is_named_once_and_has_a_table_to_read():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[1]
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) - len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and int(done.stdout) >= 0, done.stderr[-500:]
