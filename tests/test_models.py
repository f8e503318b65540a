import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fareline.plans import models as M

D = dt.date(2024, 1, 1)


def days(spark, values, entity="a"):
    return spark.createDataFrame([(entity, D + dt.timedelta(i), None if v is None else float(v)) for i, v in enumerate(values)], "e string, d date, x double")


def test_forecast_is_the_mean_of_four_weekdays_and_recurses(spark):
    values = [10 * (i % 7) + i // 7 for i in range(35)]
    found = {r.d: r.x for r in M.forecast(days(spark, values), "e", "d", "x", 14).collect()}
    grown = list(values)
    for i in range(35, 49):
        grown.append(sum(grown[i - 7 * k] for k in (1, 2, 3, 4)) / 4)
        assert found[D + dt.timedelta(i)] == pytest.approx(grown[i])
    assert len(found) == 14


def test_forecast_of_little_history(spark):
    found = M.forecast(days(spark, [4, None, 6]), "e", "d", "x", 7).collect()
    assert {r.d: r.x for r in found} == {D + dt.timedelta(7): 4.0, D + dt.timedelta(9): 6.0}
    assert M.forecast(days(spark, []), "e", "d", "x", 7).count() == 0


def test_backtest_sees_only_the_past(spark):
    r = M.backtest(days(spark, [float(i % 7) for i in range(70)]), "e", "d", "x", 14).first()
    assert r.n == 14 and r.mae == pytest.approx(0.0)


def test_daily_past_fills_days_without_a_value(spark):
    rows = {r.d: r.past for r in M.daily_past(days(spark, [float(i) if i != 20 else None for i in range(30)]), "e", "d", "x").collect()}
    assert set(rows) == {D + dt.timedelta(28), D + dt.timedelta(29)}
    past = rows[D + dt.timedelta(28)]
    assert past[0] == 27.0 and past[27] == 0.0 and past[7] == pytest.approx(sum(i for i in range(28) if i != 20) / 27)


def test_recursive_forecast_goes_step_by_step(spark):
    history = days(spark, [100 + (i % 7) * 10 for i in range(90)]).unionByName(days(spark, [50 + (i % 7) for i in range(90)], "b"))
    model = M.fit_stepper(history, "e", "d", "x", "tree")
    found = {(r.e, r.d): r.x for r in M.recursive_forecast(model, history, "e", "d", "x", 8).collect()}
    assert len(found) == 16
    for i in range(90, 98):
        assert found["a", D + dt.timedelta(i)] == pytest.approx(100 + (i % 7) * 10, abs=12)
        assert found["b", D + dt.timedelta(i)] == pytest.approx(50 + i % 7, abs=12)


def test_weights_only_for_rare_classes(spark):
    df = spark.createDataFrame([(1.0,)] * 2 + [(0.0,)] * 18, "y double")
    w = {r.y: r.weight for r in M.class_weights(df, "y").collect()}
    assert w[1.0] == pytest.approx(5.0) and w[0.0] == pytest.approx(20 / 36)
    assert {r.weight for r in M.class_weights(df, "y", below=0.05).collect()} == {1.0}


def test_threshold_with_the_best_f1(spark):
    df = spark.createDataFrame([(0.9, 1.0), (0.7, 1.0), (0.6, 0.0), (0.2, 0.0)], "p1 double, y double")
    assert M.best_threshold(df, "y", [0.1, 0.5, 0.65, 0.8]) == 0.65


def frame(spark, n=240):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        a, b = rng.uniform(0, 3), rng.uniform(0, 1)
        rows.append((("train", "train", "train", "validation", "test")[i % 5], a, b, 3 * a + b, float(int(a)), "xy"[i % 2]))
    return spark.createDataFrame(rows, "split string, a double, b double, y double, level double, kind string").cache()


def test_regression_is_chosen_on_validation_and_scored_once(spark):
    out = M.regress(frame(spark), "y", ["a", "b"], ["kind"], "a", ("linear", "tree")).collect()
    assert sorted((r.model, r.split) for r in out) == [("baseline", "test"), ("linear", "test"), ("linear", "validation"), ("tree", "validation")]
    assert all(r.chosen == (r.model == "linear") for r in out)


def test_several_classes_and_a_saved_model(spark, tmp_path):
    df = frame(spark)
    model, scores = M.choose_classifier(df, "level", ["a", "b"], ["kind"], ("forest", "one_vs_rest"))
    s = scores.collect()
    assert [r.split for r in s] == ["validation"] * 3 + ["test"] and s[-1].macro_f1 > 0.8
    again = M.saved(model, str(tmp_path / "m"))
    both = model.transform(df).select("a", "b", F.col("prediction").alias("p")).join(again.transform(df).select("a", "b", "prediction"), ["a", "b"])
    assert both.where("p != prediction").count() == 0


def test_one_cluster_is_never_chosen(spark):
    df = spark.createDataFrame([(i, float(i % 2) * 10 + i / 100, 1.0) for i in range(20)], "i int, a double, b double")
    rows, scores = M.cluster(df, ["a"], (2,), ("kmeans", "bisecting"))
    assert rows.select("cluster").distinct().count() == 2 and scores.count() == 2


def test_one_step_backtest_beside_baselines(spark):
    out = {r.model: r for r in M.one_step_backtest(days(spark, [100 + (i % 7) * 10 for i in range(120)]), "e", "d", "x", 14, "tree").collect()}
    assert {r.n for r in out.values()} == {14} and out["week_before"].mae == 0.0
    assert out["tree"].mae < out["mean"].mae
