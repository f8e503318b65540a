"""Models on the feature tables: chronological splits, one look at the test rows, honest baselines.

The estimators are MLlib's; training is distributed and seeded. What is written here is how they are fitted,
compared and used: choice on validation rows, refit on train and validation, one score on test rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fareline.functions.expr import share
from fareline.operators.aggregates import classification_report, classification_scores, regression_report
from fareline.operators.features import split_by_day
from fareline.operators.rolling import daily_values
from fareline.operators.windows import lags, prior_mean, rolling_rows
from fareline.plans.marts import mart
from fareline.plans.transit_sql import BASE
from fareline.session import checkpoint, scratch, table

SEED = 11

REGRESSORS = {
    "linear": lambda y: LinearRegression(labelCol=y, regParam=0.1),
    "tree": lambda y: DecisionTreeRegressor(labelCol=y, maxDepth=6, seed=SEED),
    "forest": lambda y: RandomForestRegressor(labelCol=y, numTrees=20, maxDepth=6, seed=SEED),
    "boosted": lambda y: GBTRegressor(labelCol=y, maxIter=10, maxDepth=4, seed=SEED),
}
CLASSIFIERS = {
    "logistic": lambda y: LogisticRegression(labelCol=y, weightCol="weight", regParam=0.01),
    "forest": lambda y: RandomForestClassifier(labelCol=y, weightCol="weight", numTrees=20, maxDepth=6, seed=SEED),
    "boosted": lambda y: GBTClassifier(labelCol=y, weightCol="weight", maxIter=10, maxDepth=4, seed=SEED),
}
CLUSTERERS = {"kmeans": KMeans, "bisecting": BisectingKMeans, "mixture": GaussianMixture}


def preprocessing(numbers: Sequence[str], categories: Sequence[str] = (), scale: bool = False) -> list:
    """Stages: median for missing numbers, an index for categories (unseen ones kept apart), one vector."""
    imputed = [f"{c}__i" for c in numbers]
    stages = [Imputer(strategy="median", inputCols=list(numbers), outputCols=imputed)]
    stages += [StringIndexer(inputCol=c, outputCol=f"{c}__x", handleInvalid="keep", stringOrderType="alphabetAsc") for c in categories]
    assembled = VectorAssembler(inputCols=[*imputed, *(f"{c}__x" for c in categories)], outputCol="raw" if scale else "features")
    return [*stages, assembled, *([StandardScaler(inputCol="raw", outputCol="features", withMean=True)] if scale else [])]


#: Candidates of a choice among several classes, each with its grid of parameters.
CHOICES = {
    "logistic": [LogisticRegression, {"regParam": (0.01, 0.1)}],
    "forest": [RandomForestClassifier, {"maxDepth": (4, 7)}],
    "one_vs_rest": [None, {"maxDepth": (3,)}],
}


def class_weights(df: DataFrame, label: str, exponent: float = 1.0, below: float = 1.0) -> DataFrame:
    """weight: the inverse frequency of the row's class, to the exponent; 1 on average for exponent 1. Where the
    rarest class has at least the share ``below`` of the rows, every weight is 1."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per class
    total = sum(counts.values())
    if not counts or min(counts.values()) >= below * total:
        return df.withColumn("weight", F.lit(1.0))
    weights = F.create_map([F.lit(x) for k, n in counts.items() for x in (k, (total / (len(counts) * n)) ** exponent)])
    return df.withColumn("weight", weights[F.col(label)])


def best_threshold(scored: DataFrame, label: str, thresholds: Sequence[float]) -> float:
    """The probability threshold with the best F1 of class 1; all are counted in one pass."""
    p, y = F.col("p1"), F.col(label)
    sums = scored.agg(F.sum(y).alias("positive"), *[F.sum(F.when(p >= t, 1).otherwise(0)).alias(f"found_{i}") for i, t in enumerate(thresholds)], *[F.sum(F.when(p >= t, y).otherwise(0)).alias(f"hit_{i}") for i, t in enumerate(thresholds)]).first()
    f1 = [2 * (sums[f"hit_{i}"] or 0) / max(1, (sums["positive"] or 0) + (sums[f"found_{i}"] or 0)) for i in range(len(thresholds))]
    return thresholds[max(range(len(thresholds)), key=lambda i: (f1[i], -i))]


def _parts(df: DataFrame) -> dict[str, DataFrame]:
    return {s: df.where(F.col("split") == s) for s in ("train", "validation", "test")}


def regress(df: DataFrame, label: str, numbers: Sequence[str], categories: Sequence[str], baseline: str, models: Sequence[str] = tuple(REGRESSORS)) -> DataFrame:
    """(model, split, n, mae, rmse, r2, mape, chosen): every model on validation rows, the one with the least
    mae, refitted, and the baseline column on test rows."""
    parts = _parts(df)
    stages = preprocessing(numbers, categories)
    scores, best = [], (float("inf"), "")
    for name in models:
        fitted = Pipeline(stages=[*stages, REGRESSORS[name](label)]).fit(parts["train"])
        score = regression_report(fitted.transform(parts["validation"]), label, "prediction")
        row = score.first()
        best = min(best, (row["mae"] if row and row["mae"] is not None else float("inf"), name))
        scores.append(score.select(F.lit(name).alias("model"), F.lit("validation").alias("split"), "*"))
    final = Pipeline(stages=[*stages, REGRESSORS[best[1]](label)]).fit(parts["train"].unionByName(parts["validation"]))
    scores.append(regression_report(final.transform(parts["test"]), label, "prediction").select(F.lit(best[1]).alias("model"), F.lit("test").alias("split"), "*"))
    scores.append(regression_report(parts["test"], label, baseline).select(F.lit("baseline").alias("model"), F.lit("test").alias("split"), "*"))
    out = scores[0]
    for s in scores[1:]:
        out = out.unionByName(s)
    return out.withColumn("chosen", F.col("model") == best[1])


def classify(df: DataFrame, label: str, numbers: Sequence[str], categories: Sequence[str], model: str = "logistic") -> DataFrame:
    """Per class precision, recall and f1 on the test rows, at the threshold that is best on validation rows."""
    parts = _parts(class_weights(df.withColumn(label, F.col(label).cast("double")), label, 0.5))
    stages = [*preprocessing(numbers, categories), CLASSIFIERS[model](label)]
    fitted = Pipeline(stages=stages).fit(parts["train"])
    at = best_threshold(_scored(fitted, parts["validation"]), label, [x / 20 for x in range(1, 20)])
    final = Pipeline(stages=stages).fit(parts["train"].unionByName(parts["validation"]))
    test = _scored(final, parts["test"]).withColumn("predicted", (F.col("p1") >= at).cast("double"))
    return classification_report(test, label, "predicted").withColumn("threshold", F.lit(at))


def choose_classifier(df: DataFrame, label: str, numbers: Sequence[str], categories: Sequence[str] = (), choices: Sequence[str] = tuple(CHOICES)) -> tuple[PipelineModel, DataFrame]:
    """(model, scores) for a label of several classes, numbered from 0: every candidate of every grid is fitted on
    train and scored on validation rows by macro F1; the best is refitted on both and scored once on test rows."""
    parts = _parts(class_weights(df.withColumn(label, F.col(label).cast("double")), label, 0.5, below=0.15))
    stages, rows, best = preprocessing(numbers, categories, scale=True), [], (-1.0, None, "")
    for name in choices:
        kind, grid = CHOICES[name]
        for parameter, values in grid.items():
            for value in values:
                if kind is None:
                    estimator = OneVsRest(classifier=GBTClassifier(maxIter=5, seed=SEED, **{parameter: value}), labelCol=label)
                else:
                    estimator = kind(labelCol=label, weightCol="weight", **({"seed": SEED, "numTrees": 10} if name == "forest" else {}), **{parameter: value})
                fitted = Pipeline(stages=[*stages, estimator]).fit(parts["train"])
                score = classification_scores(fitted.transform(parts["validation"]), label, "prediction").first()["macro_f1"] or 0.0
                rows.append((name, f"{parameter}={value}", "validation", float(score)))
                if score > best[0]:
                    best = (score, estimator, f"{name} {parameter}={value}")
    model = Pipeline(stages=[*stages, best[1]]).fit(parts["train"].unionByName(parts["validation"]))
    final = classification_scores(model.transform(parts["test"]), label, "prediction").first()["macro_f1"] or 0.0
    name, setting = best[2].split(" ", 1)
    rows.append((name, setting, "test", float(final)))
    return model, df.sparkSession.createDataFrame(rows, "model string, setting string, split string, macro_f1 double")


def saved(model: PipelineModel, path: str) -> PipelineModel:
    """The model from its files, as another program would load it."""
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def _scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("p1", vector_to_array("probability")[1])


def cluster(df: DataFrame, numbers: Sequence[str], ks: Sequence[int] = (3, 4, 5), kinds: Sequence[str] = tuple(CLUSTERERS)) -> tuple[DataFrame, DataFrame]:
    """(rows with cluster, one row per candidate): the candidate with the best silhouette; one that leaves
    all rows in a single cluster is never chosen. Every clusterer is seeded."""
    ready = Pipeline(stages=preprocessing(numbers, scale=True)).fit(df).transform(df)
    scores, best = [], (-2.0, None)
    for kind in kinds:
        for k in ks:
            rows = CLUSTERERS[kind](k=k, seed=SEED, featuresCol="features", predictionCol="cluster").fit(ready).transform(ready)
            used = rows.select("cluster").distinct().count()
            score = ClusteringEvaluator(predictionCol="cluster").evaluate(rows) if used > 1 else -1.0
            scores.append((kind, k, used, float(score)))
            if used > 1 and score > best[0]:
                best = (score, rows)
    names = df.sparkSession.createDataFrame(scores, "kind string, k int, used int, silhouette double")
    return best[1].select(*df.columns, "cluster"), names


def forecast(history: DataFrame, entity: str, day: str, value: str, horizon: int, period: int = 7) -> DataFrame:
    """(entity, day, value) for ``horizon`` days after an entity's last one.

    Each day is the mean of the four last values a multiple of ``period`` days before, however long ago,
    forecasts included: a recursion that never needs a loop over days, as a day depends on its own weekday alone. Within a weekday
    the recursion is unrolled over the (few) steps of the horizon.
    """
    rows = history.where(F.col(value).isNotNull())
    last = rows.groupBy(entity).agg(F.max(day).alias("__last"))
    aged = rows.join(last, entity).withColumn("__age", F.datediff("__last", day))
    slot = aged.withColumn("__slot", F.pmod(-F.col("__age"), F.lit(period)))
    order = Window.partitionBy(entity, "__slot").orderBy("__age")
    recent = slot.withColumn("__n", F.row_number().over(order)).where("__n <= 4")
    base = recent.groupBy(entity, "__last", "__slot").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("__n"), F.col(value).cast("double").alias("x")))), lambda s: s["x"]).alias("h"))
    steps = -(-horizon // period)
    grown = base
    for _ in range(steps):  # newest first
        mean = F.aggregate(F.slice("h", 1, 4), F.lit(0.0), lambda a, x: a + x) / F.least(F.size("h"), F.lit(4))
        grown = grown.withColumn("h", F.concat(F.array(mean), "h"))
    out = grown.withColumn("__i", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn("__ahead", (F.col("__i") - 1) * period + F.when(F.col("__slot") == 0, period).otherwise(F.col("__slot")))
    return out.where(F.col("__ahead") <= horizon).select(entity, F.date_add("__last", F.col("__ahead").cast("int")).alias(day), F.get("h", F.lit(steps) - F.col("__i")).alias(value))


#: Days of an entity's past that a step of the recursive forecast sees, newest first.
PAST = 28
STEP_FEATURES = ("lag_1", "lag_7", "lag_28", "mean_7", "mean_28", "dow")


def step_features(df: DataFrame, past: str, day: str) -> DataFrame:
    """Features of a day from the values of the PAST days before it, an array with the newest first."""
    def mean(n: int):
        return F.aggregate(F.slice(past, 1, n), F.lit(0.0), lambda a, x: a + x) / n

    return df.withColumns({**{f"lag_{n}": F.get(past, F.lit(n - 1)) for n in (1, 7, 28)}, "mean_7": mean(7), "mean_28": mean(28), "dow": F.dayofweek(day).cast("double")})


def daily_past(history: DataFrame, entity: str, day: str, value: str) -> DataFrame:
    """(entity, day, value, past) for each day that has PAST days before it; days without a value count as the
    mean of the entity's values in that time. A frame of PAST + 1 days of one entity at most is gathered."""
    d = history.where(F.col(value).isNotNull()).groupBy(entity, day).agg(F.max(value).cast("double").alias(value)).withColumn("__i", F.unix_date(day))
    w = Window.partitionBy(entity).orderBy("__i").rangeBetween(-PAST, -1)
    first = F.min("__i").over(Window.partitionBy(entity).orderBy("__i").rangeBetween(Window.unboundedPreceding, 0))
    seen = F.map_from_entries(F.collect_list(F.struct("__i", value)).over(w))
    d = d.withColumns({"__seen": seen, "__mean": F.avg(value).over(w), "__first": first}).where(F.col("__i") - F.col("__first") >= PAST)
    past = F.transform(F.sequence(F.lit(1), F.lit(PAST)), lambda n: F.coalesce(F.try_element_at("__seen", (F.col("__i") - n).cast("int")), F.col("__mean")))
    return d.select(entity, day, value, past.alias("past"))


def recursive_forecast(model: PipelineModel, history: DataFrame, entity: str, day: str, value: str, horizon: int) -> DataFrame:
    """(entity, day, value) for ``horizon`` days after an entity's last one, each predicted from those before it,
    predictions included. A loop over days, not over entities: every step is one transform of all of them, and what
    it passes on is a row of PAST values an entity; the lineage is cut every seven steps."""
    # the past of the day after the last one
    ends = history.where(F.col(value).isNotNull()).groupBy(entity).agg(F.max(day).alias("__last"))
    next_ = history.select(entity, day, value).unionByName(ends.select(entity, F.date_add("__last", 1).alias(day), F.lit(0).cast(history.schema[value].dataType).alias(value)))
    state = daily_past(next_, entity, day, value).join(ends, entity).where(F.col(day) > F.col("__last")).select(entity, day, "past")
    found = []
    for step in range(horizon):
        predicted = model.transform(step_features(state, "past", day)).select(entity, day, "past", F.greatest(F.col("prediction"), F.lit(0.0)).alias(value))
        if step % 7 == 6 or step == horizon - 1:
            predicted = checkpoint(predicted)
        found.append(predicted.select(entity, day, value))
        state = predicted.select(entity, F.date_add(day, 1).alias(day), F.concat(F.array(value), F.slice("past", 1, PAST - 1)).alias("past"))
    return reduce(DataFrame.unionByName, found)


def fit_stepper(history: DataFrame, entity: str, day: str, value: str, model: str = "boosted") -> PipelineModel:
    rows = checkpoint(step_features(daily_past(history, entity, day, value), "past", day))
    return Pipeline(stages=[*preprocessing(STEP_FEATURES), REGRESSORS[model](value)]).fit(rows)


def backtest(history: DataFrame, entity: str, day: str, value: str, horizon: int) -> DataFrame:
    """Errors of the forecast over each entity's own last ``horizon`` days, from what came before them."""
    ends = history.groupBy(entity).agg(F.max(day).alias("__end"))
    rows = history.join(ends, entity)
    before = rows.where(F.col(day) <= F.date_sub("__end", horizon)).drop("__end")
    seen = rows.where(F.col(day) > F.date_sub("__end", horizon)).select(entity, day, F.col(value).alias("actual"))
    return regression_report(seen.join(forecast(before, entity, day, value, horizon), [entity, day]), "actual", value)


def day_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route and day with lags and rolling means of earlier days, weekday, month and the split."""
    d = daily_values(table(spark, sf_dir, "route_daily_boardings"), "route_id", "service_date", "boardings", "loaded_at")
    d = d.select(F.col("entity").alias("route_id"), F.col("day").alias("service_date"), F.col("value").cast("double").alias("b")).where("b is not null")
    d = rolling_rows(rolling_rows(lags(d, ["route_id"], ["service_date"], "b", (1, 7, 28)), ["route_id"], ["service_date"], "b", 7, "last_7"), ["route_id"], ["service_date"], "b", 28, "last_28")
    d = d.withColumns({"dow": F.dayofweek("service_date").cast("string"), "month": F.month("service_date").cast("double")})
    return d.join(F.broadcast(split_by_day(d, "service_date", 0.7, 0.15)), "service_date")


def ml_daily_boardings(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = checkpoint(day_features(spark, sf_dir).where("last_28 is not null"))
    out = regress(features, "b", ["b_lag_1", "b_lag_7", "b_lag_28", "last_7", "last_28", "month"], ["dow"], "last_28", ("linear", "tree", "boosted"))
    return out.select("model", "split", "n", F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"), F.round("r2", 4).alias("r2"), "chosen")


def ml_busy_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a day exceeds the route's last four weeks by a fifth, from earlier days only."""
    features = checkpoint(day_features(spark, sf_dir).where("last_28 is not null").withColumn("busy", (F.col("b") >= 1.2 * F.col("last_28")).cast("double")))
    return classify(features, "busy", ["b_lag_1", "b_lag_7", "b_lag_28", "last_7", "last_28", "month"], ["dow"]).select("class", "support", F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"), F.round("f1", 4).alias("f1"), "threshold")


def ml_route_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily_values(table(spark, sf_dir, "route_daily_boardings"), "route_id", "service_date", "boardings", "loaded_at").where("value is not null")
    weekend = F.dayofweek("day").isin(1, 7)
    profile = d.groupBy(F.col("entity").alias("route_id")).agg(F.avg("value").alias("mean"), F.stddev("value").alias("spread"), share(weekend, F.col("day")).alias("weekend_days"), (F.avg(F.when(weekend, F.col("value"))) / F.avg("value")).alias("weekend_ratio"))
    return cluster(checkpoint(profile), ["mean", "spread", "weekend_ratio"], (3, 4), ("kmeans", "bisecting"))[0].select("route_id", "cluster")


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily_values(table(spark, sf_dir, "route_daily_boardings"), "route_id", "service_date", "boardings", "loaded_at")
    return d.select(F.col("entity").alias("route_id"), F.col("day").alias("service_date"), F.col("value").cast("double").alias("boardings")).where("boardings is not null")


def ml_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast(_history(spark, sf_dir), "route_id", "service_date", "boardings", 14).withColumn("boardings", F.round("boardings", 4))


def ml_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest(_history(spark, sf_dir), "route_id", "service_date", "boardings", 14).select("n", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "r2", "mape")])


def ml_network_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast of all routes together: total, peak day and growth over the 14 days before."""
    ahead = ml_forecast(spark, sf_dir).groupBy("service_date").agg(F.sum("boardings").alias("b"))
    h = _history(spark, sf_dir)
    recent = h.where(F.col("service_date") > F.date_sub(h.agg(F.max("service_date")).scalar(), 14)).agg(F.sum("boardings")).scalar()
    return ahead.agg(F.round(F.sum("b"), 4).alias("total"), F.max_by("service_date", "b").alias("peak_day"), F.round(F.try_divide(F.sum("b"), recent) - 1, 6).alias("growth"))


def one_step_backtest(history: DataFrame, entity: str, day: str, value: str, days: int, model: str = "boosted") -> DataFrame:
    """(model, n, mae, rmse, r2, mape) of each entity's last ``days`` days, predicted one by one from the true days
    before by a model that saw none of them, beside two baselines: a week before, and the mean of PAST days."""
    rows = checkpoint(step_features(daily_past(history, entity, day, value), "past", day))
    rows = rows.join(rows.groupBy(entity).agg(F.max(day).alias("__end")), entity)
    seen = F.col(day) <= F.date_sub("__end", days)
    fitted = Pipeline(stages=[*preprocessing(STEP_FEATURES), REGRESSORS[model](value)]).fit(rows.where(seen))
    test = fitted.transform(rows.where(~seen))
    return reduce(DataFrame.unionByName, [regression_report(test, value, c).select(F.lit(n).alias("model"), "*") for n, c in ((model, "prediction"), ("week_before", "lag_7"), ("mean", "mean_28"))])


def ml_step_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_step_backtest(_history(spark, sf_dir), "route_id", "service_date", "boardings", 14).select("model", "n", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "r2")])


def ml_recursive_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two weeks of each route, day by day from a model of the days before."""
    h = _history(spark, sf_dir)
    return recursive_forecast(fit_stepper(h, "route_id", "service_date", "boardings"), h, "route_id", "service_date", "boardings", 14).withColumn("boardings", F.round("boardings", 3))


def _trip_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured trips with what was known the day before: means of the same route, direction and hour."""
    t = mart(spark, sf_dir).trips.where("occupancy is not null and h is not null")
    cell = t.groupBy("route_id", "direction", "h", "service_date").agg(F.avg("occupancy").alias("o"), F.avg("delay").alias("d"))
    cell = prior_mean(prior_mean(cell, ["route_id", "direction", "h"], ["service_date"], "o", "usual"), ["route_id", "direction", "h"], ["service_date"], "d", "usual_delay")
    t = t.join(cell.select("route_id", "direction", "h", "service_date", "usual", "usual_delay"), ["route_id", "direction", "h", "service_date"])
    t = t.join(F.broadcast(split_by_day(t, "service_date", 0.7, 0.15)), "service_date").where("usual is not null")
    columns = {"hour": "h", "weekday": "dow", "peak_share": "peak_share", "length": "distance_km", "room": "capacity"}
    return checkpoint(t.select("split", "occupancy", "band", "usual", "usual_delay", "route_type", *[F.col(c).cast("double").alias(n) for n, c in columns.items()]))


_TRIP_NUMBERS = ("usual", "usual_delay", "hour", "weekday", "peak_share", "length", "room")


def ml_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupancy of a trip, against the mean of its cell so far."""
    out = regress(_trip_features(spark, sf_dir), "occupancy", _TRIP_NUMBERS, ["route_type"], "usual", ("linear", "tree"))
    return out.select("model", "split", "n", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r2", 4).alias("r2"), "chosen")


def _band_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = F.create_map([F.lit(x) for pair in (("low", 0), ("normal", 1), ("high", 2), ("over", 3)) for x in pair])
    return _trip_features(spark, sf_dir).withColumn("level", bands[F.col("band")].cast("double"))


def ml_band_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of occupancy: candidates and grids on validation rows, the best one on test rows."""
    _, scores = choose_classifier(_band_numbers(spark, sf_dir), "level", _TRIP_NUMBERS, ["route_type"], ("logistic", "forest"))
    return scores.withColumn("macro_f1", F.round("macro_f1", 4))


def ml_saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model saved and loaded predicts the same: rows, and how many of them differ."""
    rows = _trip_features(spark, sf_dir)
    fitted = Pipeline(stages=[*preprocessing(_TRIP_NUMBERS, ["route_type"]), REGRESSORS["tree"]("occupancy")]).fit(rows.where("split = 'train'"))
    again = saved(fitted, scratch(spark))
    both = fitted.transform(rows).select("prediction", *rows.columns).withColumnRenamed("prediction", "before")
    return again.transform(both).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("before") != F.col("prediction"), 1)).alias("differing"))


QUERIES = {f.__name__: f for f in (ml_daily_boardings, ml_busy_day, ml_route_clusters, ml_forecast, ml_backtest, ml_network_forecast, ml_recursive_forecast, ml_step_backtest, ml_occupancy, ml_band_choice, ml_saved_model)}
_HISTORY = "SELECT route_id, service_date, b AS boardings FROM (SELECT route_id, service_date, arg_max_null(boardings, (loaded_at, boardings))::DOUBLE AS b FROM route_daily_boardings WHERE route_id <> '' AND service_date IS NOT NULL GROUP BY ALL) WHERE b IS NOT NULL"


def _forecast_sql(history: str) -> str:
    """Two weeks as means of the four last values of the weekday, the second week with the first among them."""
    return f"""(WITH h AS ({history}), e AS (SELECT route_id, max(service_date) AS last FROM h GROUP BY 1),
g AS (SELECT h.*, last, date_diff('day', service_date, last) AS age FROM h JOIN e USING (route_id)),
n AS (SELECT *, (7 - age % 7) % 7 AS slot, row_number() OVER (PARTITION BY route_id, age % 7 ORDER BY age) AS r FROM g),
f AS (SELECT route_id, last, slot, list(boardings ORDER BY r) AS v FROM n WHERE r <= 4 GROUP BY ALL),
o AS (SELECT *, list_sum(v) / len(v) AS one FROM f), w AS (SELECT *, (one + coalesce(list_sum(v[1:3]), 0)) / least(len(v) + 1, 4) AS two FROM o)
SELECT route_id, (last + CASE slot WHEN 0 THEN 7 ELSE slot END::INT)::DATE AS service_date, one AS boardings FROM w
UNION ALL SELECT route_id, (last + CASE slot WHEN 0 THEN 14 ELSE slot + 7 END::INT)::DATE, two FROM w)"""


_BEFORE = f"SELECT h.* FROM ({_HISTORY}) h JOIN (SELECT route_id, max(service_date) AS fin FROM ({_HISTORY}) GROUP BY 1) USING (route_id) WHERE service_date <= fin - 14"
#: The other results hang on the estimators' own numerics.
SQL: dict[str, str] = {
    "ml_forecast": f"SELECT route_id, service_date, round(boardings, 4) AS boardings FROM {_forecast_sql(_HISTORY)}",
    "ml_backtest": f"SELECT count(*) AS n, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) ** 2)), 4) AS rmse, round(1 - sum((y - p) ** 2) / nullif(var_pop(y) * count(*), 0), 4) AS r2, round(avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END), 4) AS mape FROM (SELECT h.boardings AS y, f.boardings AS p FROM ({_HISTORY}) h JOIN {_forecast_sql(_BEFORE)} f USING (route_id, service_date) JOIN (SELECT route_id, max(service_date) AS fin FROM ({_HISTORY}) GROUP BY 1) USING (route_id) WHERE service_date > fin - 14)",
    "ml_network_forecast": f"WITH a AS (SELECT service_date, sum(boardings) AS b FROM (SELECT service_date, round(boardings, 4) AS boardings FROM {_forecast_sql(_HISTORY)}) GROUP BY 1), h AS ({_HISTORY}) SELECT round(sum(b), 4) AS total, arg_max(service_date, b) AS peak_day, round(sum(b) / (SELECT sum(boardings) FROM h WHERE service_date > (SELECT max(service_date) FROM h) - 14) - 1, 6) AS growth FROM a",
    "ml_saved_model": BASE + " SELECT count(*) AS n, CAST(0 AS BIGINT) AS differing FROM (SELECT *, min(service_date) OVER (PARTITION BY route_id, direction, h) AS first FROM t WHERE occupancy IS NOT NULL AND h IS NOT NULL) WHERE service_date > first",
}
