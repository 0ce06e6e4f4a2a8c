"""Choice, guard, kept models and artifacts, on small made-up errors."""

from __future__ import annotations

import datetime as dt

import pytest

from marlspike.operators import champion as C
from marlspike.sources.scratch import fresh_path

ERRORS = "horizon int, model string, place int, mae double, n long"
ZERO = "zero-return baseline"


def choice(spark, validation, test):
    chosen = C.argmin_model(spark.createDataFrame(validation, ERRORS))
    return {r["horizon"]: r for r in C.promotion(chosen, spark.createDataFrame(test, ERRORS)).collect()}


def test_least_error_first_of_ties_and_refusals(spark):
    nan = float("nan")
    validation = [(1, ZERO, 0, 0.5, 9), (1, "a", 1, 0.4, 9), (1, "b", 2, 0.4, 9), (2, ZERO, 0, 0.5, 9), (2, "a", 1, nan, 9), (2, "b", 2, None, 9), (2, "c", 3, 0.1, 0), (3, ZERO, 0, 0.5, 9), (3, "a", 1, 0.3, 9), (4, "a", 1, None, 0), (5, ZERO, 0, 0.5, 9), (5, "a", 1, 0.2, 9), (6, "a", 1, 0.2, 9)]
    test = [(1, ZERO, 0, 0.5, 9), (1, "a", 1, 0.49, 9), (2, ZERO, 0, 0.5, 9), (3, ZERO, 0, 0.3, 9), (3, "a", 1, 0.3, 9), (5, ZERO, 0, 0.5, 9), (6, "a", 1, 0.1, 9)]
    got = choice(spark, validation, test)
    assert {h: (r["model"], r["reason"], r["approved"]) for h, r in got.items()} == {1: ("a", "PROMOTED", True), 2: (ZERO, "BASELINE_IS_BEST", False), 3: ("a", "DOES_NOT_BEAT_BASELINE", False), 4: (None, "NO_CANDIDATE", False), 5: ("a", "NO_TEST_ROWS", False), 6: ("a", "NO_BASELINE", False)}


@pytest.mark.parametrize("value", [None, 0.25])
def test_constants_and_none_are_kept(spark, value):
    path = fresh_path(spark, "model")
    C.Model("m", value).save(spark, path)
    rows = spark.createDataFrame([(1, None), (2, 3.0)], "id long, x double")
    assert [tuple(r) for r in C.Model.load(spark, path).predict(rows).collect()] == [(1, None, value), (2, 3.0, value)]


def test_fitted_pipeline_is_kept_and_gives_null_where_it_finds_no_number(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(20)], "x double, y double")
    fitted = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="v", handleInvalid="keep"), LinearRegression(featuresCol="v", labelCol="y")]).fit(rows)
    path = fresh_path(spark, "model")
    C.Model("line", fitted=fitted).save(spark, path)
    got = C.Model.load(spark, path).predict(spark.createDataFrame([(1, 10.0), (2, None)], "id long, x double"))
    assert got.columns == ["id", "x", "prediction"]
    assert {r["id"]: r["prediction"] and round(r["prediction"], 6) for r in got.collect()} == {1: 21.0, 2: None}


def test_every_record_has_every_field(spark):
    today = dt.date(2024, 5, 1)
    latest = spark.createDataFrame([(t, today - dt.timedelta(days=d), today, 10.0) for t, d in (("fresh", 0), ("old", 11), ("few", 1), ("none", 10))], "ticker string, day date, as_of date, price double")
    scenarios = spark.createDataFrame([(t, 30, s, b, b, b, None) for t, s, b in (("fresh", "available", 0.1), ("old", "available", 0.1), ("few", "insufficient_data", None))], "ticker string, horizon int, status string, base_return double, lower_return double, upper_return double, price double")
    predictions = spark.createDataFrame([("fresh", 30, 0.5), ("old", 30, 0.5), ("few", 30, None)], "ticker string, horizon int, prediction double")
    promoted = spark.createDataFrame([(30, "a", True, "PROMOTED")], "horizon int, model string, approved boolean, reason string")
    records = C.artifacts(latest, scenarios, predictions, promoted)
    got = {r["ticker"]: r for r in records.collect()}
    assert {t: (r["status"], r["reason"], r["display_source"]) for t, r in got.items()} == {"fresh": ("available", None, "model"), "old": ("stale", "STALE_PRICES", "unavailable"), "few": ("insufficient_data", "INSUFFICIENT_SAMPLES", "unavailable"), "none": ("unavailable", "NO_SCENARIO", "unavailable")}
    assert got["fresh"]["forecast"]["predicted_price"] == 16.4872 and got["old"]["forecast"] is None and got["old"]["scenario"] is None
    assert dict(records.dtypes)["forecast"].startswith("struct<predicted_return:double") and got["none"]["validation"] == "validated"
    shown = C.artifacts(latest, scenarios, None, promoted.selectExpr("horizon", "model", "false as approved", "'DOES_NOT_BEAT_BASELINE' as reason"))
    assert C.summary(shown).first().asDict() == {"horizon": 30, "records": 4, "n_available": 1, "n_insufficient_data": 1, "n_stale": 1, "n_unavailable": 1, "shown_model": 0, "shown_scenario": 1, "shown_unavailable": 3}
