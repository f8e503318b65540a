import datetime as dt

import pytest
from pyspark.sql import functions as F

from fareline.functions import expr as E
from fareline.operators import aggregates as A
from fareline.operators import cleaning as C
from fareline.operators import features as X
from fareline.operators import joins as J
from fareline.operators import quality as Q
from fareline.operators import skew as S
from fareline.operators import windows as W

D = dt.date(2024, 1, 1)


def day(n):
    return D + dt.timedelta(n)


def test_bands_and_shares_keep_missing_values_missing(spark, rows):
    df = spark.createDataFrame([(1, None), (2, 0.0), (3, 10.0), (4, 99.0)], "id int, x double")
    assert rows(df.select("id", E.band(F.col("x"), ((10.0, "low"), (50.0, "mid"), (None, "high"))))) == [(1, None), (2, "low"), (3, "mid"), (4, "high")]
    assert rows(df.agg(E.share(F.col("x") > 5, F.col("x")))) == [(2 / 3,)]
    assert rows(df.where("id = 1").agg(E.share(F.col("x") > 5, F.col("x")))) == [(None,)]


def test_median_of_even_history(spark, rows):
    df = spark.createDataFrame([([4.0, 1.0, 3.0, 2.0],), ([5.0],), ([],)], "h array<double>")
    assert rows(df.select(E.median_of(F.col("h")), E.median_of(F.col("h"), lower=True))) == [(2.5, 2.0), (5.0, 5.0), (None, None)]


def test_windows_never_see_the_day_itself(spark, rows):
    data = [("a", i, float(i)) for i in range(40)]
    df = spark.createDataFrame(data, "e string, d int, x double")
    loud = df.withColumn("x", F.when(F.col("d") == 30, F.col("x") * 10).otherwise(F.col("x")))
    for op in (lambda f: W.growth(f, ["e"], "d", "x", 7, "o"), lambda f: W.prior_mean(f, ["e"], ["d"], "x", "o"), lambda f: W.history_median(f, ["e"], "d", "x", -28, -7, "o"), lambda f: W.trailing_mean(f, ["e"], "d", "x", -28, -1, "o")):
        assert rows(op(df).where("d = 30"), "o") == rows(op(loud).where("d = 30"), "o")


def test_history_below_the_least_is_unknown(spark, rows):
    df = spark.createDataFrame([("a", i * 7, float(i)) for i in range(6)], "e string, d int, x double")
    assert rows(W.history_median(df, ["e"], "d", "x", -56, -7, "m", least=4), "m_n", "m") == [(0, None), (1, None), (2, None), (3, None), (4, 1.5), (5, 2.0)]


def test_previous_kept_skips_what_did_not_run(spark, rows):
    df = spark.createDataFrame([("a", 1, "ok"), ("a", 2, "cancelled"), ("a", 3, "ok"), ("a", 3, None)], "e string, t int, s string")
    assert rows(W.previous_kept(df, ["e"], ["t", "s"], "t", F.col("s") == "ok", "p"), "t", "s", "p") == [(1, "ok", None), (2, "cancelled", 1), (3, "ok", 1), (3, None, 1)]


def test_nested_intervals_overlap(spark, rows):
    df = spark.createDataFrame([("a", 0, 100), ("a", 10, 20), ("a", 30, 40), ("a", 100, 110)], "e string, s int, t int")
    assert rows(W.overlaps_earlier(df, ["e"], "s", "t", "o"), "s", "o") == [(0, False), (10, True), (100, False), (30, True)]


def test_joins(spark, rows):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "id int, k string")
    right = spark.createDataFrame([("a", 1), ("a", 2), ("c", 3)], "k string, v int")
    assert rows(J.measured_left_join(left, right, ["k"])) == [(4, 6, 2)]
    assert rows(J.measured_left_join(left.limit(0), right, ["k"])) == [(0, 0, 0)]
    assert rows(J.unambiguous_lookup(right, "k", "v")) == [("c", 3)]
    assert rows(J.latest_rows(right, ["k"], "v", "v")) == [("a", 2), ("c", 3)]
    sizes = spark.createDataFrame([(10, "s"), (40, "m"), (40, "l"), (None, "x")], "size int, kind string")
    needs = spark.createDataFrame([(1, 0.5), (2, 10.0), (3, 10.1), (4, 41.0), (5, None)], "id int, need double")
    assert rows(J.smallest_fit(needs, "need", sizes, "size", "kind"), "id", "size", "kind") == [(1, 10, "s"), (2, 10, "s"), (3, 40, "l"), (4, None, None), (5, None, None)]


def test_mismatches_are_null_safe(spark, rows):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 1.0), (4, 2.0)], "id int, x double")
    b = spark.createDataFrame([(1, 1.0 + 1e-12), (2, None), (3, None), (5, 2.0)], "id int, x double")
    assert rows(J.mismatches(a, b, ["id"], ["x"])) == [(3,), (4,), (5,)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_is_a_join(spark, rows, how):
    left = spark.createDataFrame([("hot", i) for i in range(500)] + [("b", 1), ("c", 2), (None, 3)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("b", 3), ("z", 4)], "k string, v int")
    assert rows(S.skew_join(left, right, "k", how, max_rows=20)) == rows(left.join(right, "k", how))
    assert S.hot_keys(left, "k", 20) == (503, {"hot": 500})
    assert S.hot_keys(left.limit(0), "k", 20) == (0, {})


def test_dense_grid(spark, rows):
    f = spark.createDataFrame([("a", day(0), 2), ("b", day(2), 1)], "c string, d date, n int")
    assert rows(J.dense_grid(f, ["c"], "d", ["n"])) == [(c, day(i), n) for c, i, n in [("a", 0, 2), ("a", 1, 0), ("a", 2, 0), ("b", 0, 0), ("b", 1, 0), ("b", 2, 1)]]


def test_factor_falls_back(spark, rows):
    cells = spark.createDataFrame([("r", "p", 10, 40), ("r", "q", 6, 2), ("s", "p", 9, 3)], "r string, p string, t int, b int")
    out = A.factor_with_fallback(cells, [["r", "p"], ["r"], []], "t", "b", 30, ["cell", "route", "all"])
    assert rows(out, "r", "p", "factor", "factor_level") == [("r", "p", 0.25, "cell"), ("r", "q", 16 / 42, "route"), ("s", "p", 25 / 45, "all")]


def test_fingerprint_ignores_order(spark, rows):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    assert rows(A.fingerprint(df)) == rows(A.fingerprint(df.orderBy(F.desc("id")).repartition(7)))
    assert rows(A.fingerprint(df)) != rows(A.fingerprint(df.withColumn("x", F.col("x") + 1)))
    assert rows(A.fingerprint(df.limit(0))) == [(0, 0)]


def test_reports(spark, rows):
    c = A.classification_report(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "c")], "l string, p string"), "l", "p")
    assert rows(c) == [("a", 2, 1.0, 0.5, 2 / 3), ("b", 2, 0.5, 0.5, 0.5), ("c", 0, 0.0, None, 0.0)]
    r = A.regression_report(spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (None, 5.0)], "y double, p double"), "y", "p").first()
    assert (r.n, r.mae, r.rmse, r.r2, r.mape) == (2, 1.0, 1.0, 0.0, 0.5)


def test_column_profile(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), (None, None), ("b", 3)], "s string, x int")
    p = {r.column: r.asDict() for r in A.column_profile(df, ["s", "x"]).collect()}
    assert (p["s"]["rows"], p["s"]["nulls"], p["s"]["distinct_values"], p["s"]["top_values"], p["s"]["mean"]) == (4, 1, 2, "a:2, b:1", None)
    assert (p["x"]["min"], p["x"]["max"], p["x"]["q50"], p["x"]["top_values"]) == ("1.0", "3.0", 3.0, "3:2, 1:1")
    assert abs(p["x"]["std"] - 1.1547005) < 1e-6
    assert A.column_profile(df.limit(0), ["s", "x"]).count() == 0


def catalog(spark):
    t = spark.createDataFrame([("1", "p", -1, D, None), ("1", "p", -1, D, None), ("2", None, 5, day(1), D), ("2", "x", 5, day(1), D), (None, " ", None, None, None)], "id string, parent string, n int, a date, b date")
    p = spark.createDataFrame([("p",), ("q",)], "key string")
    bad = spark.createDataFrame([("9", "n,a", "9,p,zz"), ("8", "b", "8")], "id string, failed_columns string, raw_record string")
    return Q.Catalog({"t": t, "p": p}, {"t": ["id"], "p": ["key"]}, {"t": bad})


def test_checks(spark, rows):
    c = catalog(spark)

    def found(check, **params):
        return rows(Q.run_rule(c, Q.Rule("R", check, "t", params=params)), "record_key", "column", "observed_value", "units")

    assert found("required_value", column="parent") == [("", "parent", " ", 1), ("2", "parent", None, 1)]
    assert found("foreign_key", columns=["parent"], parent_table="p", parent_key="key") == [("", "parent", " ", 1), ("2", "parent", "x", 1)]
    assert found("duplicate_key") == [("1", "id", "identical", 1), ("2", "id", "conflicting", 1)]
    assert found("non_negative", columns=["n"]) == [("1", "n", "-1", 1)] * 2
    assert found("unparseable", columns=["n"]) == [("9", "n", "9,p,zz", 1)]
    assert found("time_order", earlier="a", later="b") == [("2", "b", "2024-01-01", 1)] * 2
    assert found("value_range", column="n", low=0, include_unparseable=True) == [("1", "n", "-1", 1)] * 2 + [("9", "n", "9,p,zz", 1)]
    assert found("value_range", column="n", low=5, low_exclusive=True) == [("1", "n", "-1", 1)] * 2 + [("2", "n", "5", 1)] * 2
    with pytest.raises(KeyError):
        found("no_such_check")


def test_sequences(spark, rows):
    s = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 4), ("c", 1), ("c", 2), ("c", 2), ("d", 2), ("e", None)], "g string, n int")
    c = Q.Catalog({"s": s}, {"s": ["g", "n"]})
    assert [r[0] for r in rows(Q.run_rule(c, Q.Rule("R", "sequence_integrity", "s", params={"group_by": ["g"], "sequence_column": "n"})), "record_key")] == ["b", "c", "d", "e"]


def test_cleaning_balances(spark, rows):
    ts = dt.datetime(2024, 1, 1, 8)
    data = [("1", "t1", "r", 5.0, ts, ts + dt.timedelta(minutes=5)), ("1", "t1", "r", 5.0, ts, ts + dt.timedelta(minutes=5)), ("2", "t2", "", 9999.0, ts, ts + dt.timedelta(minutes=7)), ("3", "t3", "r", 9999.0, ts, None), ("4", "t4", "r", 1.0, ts, ts + dt.timedelta(days=3)), ("5", "t1", "r", 1.0, ts, ts), ("5", "t1", "r", 2.0, ts, ts)]
    df = spark.createDataFrame(data, "id string, trip string, route string, m double, s timestamp_ntz, e timestamp_ntz")
    kept, removed, conflicting = C.split_duplicates(df, ["id"])
    assert (kept.count(), rows(removed), conflicting.count()) == (4, [("1", 1)], 2)
    c = Q.Catalog({"t": kept}, {"t": ["id"]})
    rules = [Q.Rule("A", "value_range", "t", action="correct", params={"column": "m", "high": 600}), Q.Rule("B", "required_value", "t", action="correct", params={"column": "route"}), Q.Rule("C", "time_gap", "t", action="quarantine", params={"column": "e", "reference": "s", "hours": 12})]
    lookup = spark.createDataFrame([("t2", "r2"), ("t1", "x"), ("t1", "y")], "trip string, route string")
    fixes = {"A": C.from_minutes("m", "s", "e", -60, 600), "B": C.from_lookup("route", "trip", lookup, "route")}
    out = C.clean(c, "t", rules, Q.run_rules(c, rules), fixes)
    assert rows(out, "id", "route", "m", "dq_status", "dq_corrected") == [("1", "r", 5.0, "clean", []), ("2", "r2", 7.0, "corrected", ["A", "B"]), ("3", "r", 9999.0, "flagged", []), ("4", "r", 1.0, "quarantined", [])]
    log = rows(C.audit_log(out, "t", rules, fixes), "record_key", "rule_id", "original_value", "corrected_value", "action", "final_status")
    assert ("2", "A", "9999.0", "7.0", "correct", "corrected") in log and len(log) == 4
    balance = C.reconcile(df, out.where("dq_status != 'quarantined'"), removed, out.where("dq_status = 'quarantined'").unionByName(conflicting, allowMissingColumns=True))
    assert rows(balance) == [(7, 3, 1, 3, True)]


def test_split_is_chronological(spark, rows):
    df = spark.createDataFrame([(day(i),) for i in range(20)] + [(None,)], "d date")
    s = X.split_by_day(df, "d", 0.7, 0.15)
    assert rows(s.groupBy("split").count()) == [("test", 3), ("train", 14), ("validation", 3)]
    assert rows(X.chronology(s, "d")) == [(True, True)]


def test_peaks_come_from_earlier_days(spark, rows):
    df = spark.createDataFrame([("a", day(i), h, "w", 10 if h == 8 else 1) for i in range(3) for h in (8, 9)], "e string, d date, h int, k string, n int")
    out = X.peak_share(df, "e", "d", "h", "k", "n", least=0.5)
    assert rows(out.where(F.col("d") == day(0)), "h", "share_asof") == [(8, None), (9, None)]
    assert rows(out.where(F.col("d") == day(2)), "h", "is_peak") == [(8, True), (9, False)]


def test_open_ended_intervals_overlap_what_begins_later(spark, rows):
    s = spark.createDataFrame([("a", "g", 1, None), ("b", "g", 5, 6), ("c", "g", 9, None), ("d", "h", 1, 4), ("e", "h", 4, None), ("f", "h", None, 2), ("i", "k", 3, None), ("j", "k", 3, 5)], "id string, g string, x int, y int")
    c = Q.Catalog({"s": s}, {"s": ["id"]})
    params = {"group_by": ["g"], "start": "x", "end": "y"}
    assert [r[0] for r in rows(Q.run_rule(c, Q.Rule("R", "overlapping_intervals", "s", params=params | {"open_end": True})), "record_key")] == ["b", "c", "d", "i"]
    assert [r[0] for r in rows(Q.run_rule(c, Q.Rule("R", "overlapping_intervals", "s", params=params)), "record_key")] == ["d"]


def test_forecast_takes_a_weekdays_last_values_however_old(spark, rows):
    from fareline.plans.models import forecast

    history = spark.createDataFrame([("r", day(0), 5.0), ("r", day(7), 7.0), ("r", day(141), 9.0)], "e string, d date, x double")
    assert rows(forecast(history, "e", "d", "x", 7), "d", "x") == [(day(147), 6.0), (day(148), 9.0)]


def test_bands_that_do_not_fit_their_labels_are_refused(spark, rows):
    df = spark.createDataFrame([(1.0,), (9.0,), (None,)], "x double")
    assert rows(df.select(E.guarded_band(F.col("x"), ((5.0, "a"), (None, "b")), ("a", "b")))) == [("a",), ("b",), (None,)]
    for bands, labels in ((((5.0, "a"), (None, "b")), ("b", "a")), (((5.0, "a"), (3.0, "b"), (None, "c")), ("a", "b", "c")), (((5.0, "a"), (9.0, "b")), ("a", "b"))):
        with pytest.raises(ValueError):
            E.guarded_band(F.col("x"), bands, labels)


def test_two_labellings(spark, rows):
    same = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("b", 2), (None, 2)], "x string, y int")
    assert A.adjusted_rand(same, "x", "y").first().adjusted_rand == pytest.approx(1.0)
    mixed = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2)], "x string, y int")
    assert A.adjusted_rand(mixed, "x", "y").first().adjusted_rand == pytest.approx(-0.5)
    assert rows(A.crosstab(same, "x", "y")) == [("a", 1, 2), ("b", 2, 2)]


def test_scores_and_parity(spark, rows):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "l string, p string")
    s = A.classification_scores(df, "l", "p").first()
    assert (s.accuracy, s.macro_f1) == (0.5, pytest.approx((2 / 3 + 0.5 + 0) / 3)) and s.weighted_f1 == pytest.approx((2 * 2 / 3 + 0.5) / 4)
    a = spark.createDataFrame([(1, "x"), (2, "y")], "n int, k string")
    b = spark.createDataFrame([(1, "x"), (3, "x")], "n int, k string")
    assert rows(A.store_parity(a, b), "column", "sum_a", "sum_b", "same") == [("k", None, None, False), ("n", 3.0, 4.0, False)]
    assert all(r.same for r in A.store_parity(a, a).collect())
    assert rows(A.band_accuracy(spark.createDataFrame([(10.0, 11.0), (10.0, 12.5), (None, 1.0)], "y double, p double"), "y", "p", {"near": (1.0, 0.0), "part": (0.0, 0.3)})) == [(0.5, 1.0, 2)]
    assert rows(A.flat_metrics(spark.createDataFrame([("g", 1, None)], "g string, a int, b double"), "g", ["a", "b"])) == [("g", "a", 1.0)]


def test_corrections_of_coordinates_and_sequences(spark, rows):
    df = spark.createDataFrame([(1, 33.2, 12.1), (2, 50.0, 12.1), (3, None, 12.1)], "id int, lat double, lon double")
    lat, lon = C.swapped("lat", "lon", [11.9, 12.6, 33.0, 33.8])
    assert rows(df.select("id", lat.apply(df)[1], lon.apply(df)[1])) == [(1, 12.1, 33.2), (2, None, None), (3, None, None)]
    lines = spark.createDataFrame([("o", 5, "b"), ("o", 5, "a"), ("p", 2, "c")], "g string, n int, k string")
    assert rows(lines.select("g", "k", C.resequenced("n", ["g"], ["n", "k"]).apply(lines)[1].alias("n"))) == [("o", "a", 1), ("o", "b", 2), ("p", "c", 1)]


def test_results_with_clashing_columns_are_not_joined(spark):
    a = spark.createDataFrame([(1, 2)], "k int, v int")
    with pytest.raises(ValueError):
        J.inner_on(a, a, ["k"])
    assert J.inner_on(a, a.withColumnRenamed("v", "w"), ["k"]).count() == 1


def test_row_rules_of_a_table_take_one_scan(spark):
    t = spark.createDataFrame([("1", -1, None), ("2", 5, "x")], "id string, n int, s string")
    c = Q.Catalog({"t": t}, {"t": ["id"]})
    found = Q.run_rules(c, [Q.Rule("A", "non_negative", "t", params={"columns": ["n"]}), Q.Rule("B", "required_value", "t", params={"column": "s"}), Q.Rule("C", "value_range", "t", params={"column": "n", "high": 3})])
    assert sorted((r.rule_id, r.record_key) for r in found.collect()) == [("A", "1"), ("B", "1"), ("C", "2")]
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
    with pytest.raises(KeyError):
        Q.run_rules(c, [Q.Rule("X", "no_such_check", "t")])
