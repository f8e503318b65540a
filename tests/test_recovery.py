import csv
import io
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fareline.sources.recovery import Contract, Grammar, is_decimal, is_int32, is_moment, line_verdict, parse, parse_lines, parse_texts, typed, verdict

C = Contract(("id", "name", "n"), r'"?K[0-9]+"?,', {"n": is_int32})
ANCHOR = re.compile(C.anchor)


def reason(line):
    wrong, _ = line_verdict(line, C, ANCHOR)
    return wrong and wrong[0]


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("K1,a,5", None), ('K1,"a, ""b""\nc",5', None), ("K1,,", None), ('K1,"",""', None), ("K1,a,5 ", "value"), ("K1,a,5.0", "value"), ("K1,a,2147483648", "value"), ("K1,a,-2147483648", None),
        ("K1,a,٣", "value"), ("K1,a", "columns"), ("K1,a,5,6", "columns"), ("", "columns"), (None, "columns"), ('K1,a"b,5', "quoting"), ('K1,"a"b,5', "quoting"), ('K1,"a,5', "quoting"), ('K1,"a" ,5', "quoting"),
        ("K1,a,5\nK2,b,6", "columns"), ('K1,"a"\nK2,b', "quoting"), ("K1,a\r\nb,5", None), ("K1,a,5\n", "value"), ('K1,\n"a",5', "quoting"), ('K1,"a,x\nK2,b,6', "quoting"),
    ],
)
def test_first_reason(line, expected):
    assert reason(line) == expected


def test_resumes_at_a_validated_record_start():
    text = 'K1,a,1\nK2,"broken,2\nnot a record\nK3,"x\nK9,y",3\nK4,b\nK5,c,5'
    records = parse(text, C)
    assert [r.values[0] for r in records if not r.error] == ["K1", "K3", "K4", "K5"]
    (broken,) = [r for r in records if r.error]
    assert broken.begin == 7 and broken.error == (text.index("x\nK9"), "text after a closing quote")
    assert [verdict(r, C) and verdict(r, C)[0] for r in records] == [None, "quoting", None, "columns", None]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab",\n 7', max_size=8), min_size=3, max_size=3))
def test_round_trip_with_a_writer(values):
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(values)
    records = parse(out.getvalue(), C)
    assert len(records) == 1 and records[0].error is None and records[0].values == values


def test_values():
    assert [is_decimal(x) for x in ("1", "-1.5", "+0", "1.", ".5", "1e3", " 1")] == [True, True, True, False, False, False, False]
    assert [is_moment(x) for x in ("2024-02-29 23:59:59", "2023-02-29 00:00:00", "2024-01-01 24:00:00", "2024-01-01 00:00:60", "2024-01-01T00:00:00")] == [True, False, False, False, False]
    assert is_int32("0" * 5000 + "1") and not is_int32("1" * 5000)


def test_lines_to_typed_rows(spark, rows):
    lines = spark.createDataFrame([(1, "t", "K1,a,5", "x"), (2, "t", 'K2,"b', "x"), (3, "other", "z", "x"), (4, None, None, "x"), (5, "t", "K3,,", "x")], "record_id long, table_name string, raw_line string, reason string")
    parsed = parse_lines(lines, {"t": C}, "record_id")
    assert rows(parsed, "record_id", "reason") == [(1, None), (2, "quoting"), (3, "table"), (4, "table"), (5, None)]
    assert rows(typed(parsed, C, "t", "record_id", ["string", "string", "int"])) == [(1, "K1", "a", 5), (5, "K3", None, None)]
    assert parse_lines(lines.limit(0), {"t": C}, "record_id").count() == 0


def test_every_failing_line_is_a_violation_of_its_table(spark, tmp_path):
    from fareline.plans.catalog import QUERIES

    lines = [(1, "delays", "D1,a"), (2, "tickets", "K2" + "," * 7 + "soon" + "," * 5), (3, "passenger_counts", 'C3,"x' + "," * 9), (4, "passenger_counts", "C4,t,r,,v,many" + "," * 5), (5, "tickets", "K5" + "," * 12)]
    spark.createDataFrame(lines, "record_id long, table_name string, raw_line string").write.parquet(str(tmp_path / "raw_records.parquet"))
    for name in ("delays", "tickets", "passenger_counts"):
        spark.createDataFrame([], "trip_id string").write.parquet(str(tmp_path / f"{name}.parquet"))
    found = QUERIES["dq_unparseable"](spark, str(tmp_path)).collect()
    text = {str(i): line for i, _, line in lines}
    assert sorted((r.record_key, r.table, r.column) for r in found) == [("1", "delays", "columns"), ("2", "tickets", "entry_time"), ("3", "passenger_counts", "quoting"), ("4", "passenger_counts", "boardings")]
    assert all(r.observed_value == text[r.record_key] for r in found)


BLOCK = 'K1,a,1\nK2,"broken,2\nnot a record\nK3,b,3\n\nK4,c\nK5,"d\ne",x'


def test_texts_of_many_records(spark):
    df = spark.createDataFrame([("p", "t", BLOCK), ("q", "t", None), ("r", "t", ""), ("s", "u", "K1,a,1")], "part string, table_name string, text string")
    found = [(r.part, r.record_no, r.reason, r["values"] and r["values"][0]) for r in parse_texts(df, {"t": C}, "part").orderBy("part", "record_no").collect()]
    assert found == [("p", 0, None, "K1"), ("p", 1, "quoting", None), ("p", 2, None, "K3"), ("p", 3, "columns", None), ("p", 4, "value", None), ("s", 0, "table", None)]


def test_without_resuming_the_records_after_a_broken_one_are_lost(monkeypatch):
    monkeypatch.setattr(Grammar, "resume", lambda self: setattr(self, "at", len(self.text)))
    assert [r.values[0] for r in parse(BLOCK, C) if not r.error] == ["K1"]
    monkeypatch.undo()
    assert [r.values[0] for r in parse(BLOCK, C) if not r.error] == ["K1", "K3", "", "K4", "K5"]
