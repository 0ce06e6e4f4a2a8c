"""Queries of the champion's choice, its guard and the forecast artifacts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspike.operators import champion as C
from marlspike.operators import forecast as FC
from marlspike.sources.scratch import written

from .forecast_queries import ROWS, SCEN, _kept_rows, _scenarios
from .registry import query

HORIZONS = (30, 90)
#: Candidates in their order: two constants and a straight line on each of two features, fitted to the training part.
LINES = {"momentum-21": "return_21", "momentum-63": "return_63"}
MODELS = ["zero-return baseline", "historical-mean baseline", *LINES]


def _fits(parts: DataFrame, target: str) -> dict:
    """The mean and the lines of the training part: one row, whatever the table."""
    x = parts.where("part = 'train'")
    return x.agg(F.avg(target).alias("mean"), *[f(target, c).alias(f"{n}_{c}") for c in LINES.values() for n, f in (("slope", F.regr_slope), ("intercept", F.regr_intercept))]).first().asDict()


def _predictions(fit: dict) -> list:
    lines = [F.lit(fit[f"intercept_{c}"]) + F.lit(fit[f"slope_{c}"]) * F.col(c) for c in LINES.values()]
    return [F.struct(F.lit(k).alias("place"), F.lit(m).alias("model"), p.cast("double").alias("f")) for k, (m, p) in enumerate(zip(MODELS, [F.lit(0.0), F.lit(fit["mean"]), *lines]))]


def _errors(rows: DataFrame) -> tuple[DataFrame, dict]:
    """(horizon, part, place, model, mae, n) over validation and test rows, and each horizon's fits."""
    fits, done = {}, []
    for h in HORIZONS:
        parts = FC.split(rows, f"target_{h}", h)
        fits[h] = _fits(parts, f"target_{h}")
        long = parts.where("part in ('validation', 'test')").select("part", F.col(f"target_{h}").alias("y"), F.explode(F.array(*_predictions(fits[h]))).alias("m"))
        done.append(long.groupBy(F.lit(h).alias("horizon"), "part", "m.place", "m.model").agg(F.round(F.avg(F.abs(F.col("m.f") - F.col("y"))), 6).alias("mae"), F.count("m.f").alias("n")))
    return written(reduce(DataFrame.unionByName, done), "errors"), fits


def _promoted(errors: DataFrame) -> DataFrame:
    chosen = C.argmin_model(errors.where("part = 'validation'"))
    return C.promotion(chosen, errors.where("part = 'test'"))


def _split_sql(h: int) -> str:
    fits = ", ".join(f"regr_slope(target_{h}, {c}) AS slope_{c}, regr_intercept(target_{h}, {c}) AS intercept_{c}" for c in LINES.values())
    values = " UNION ALL ".join([f"SELECT part, target_{h} AS y, {k} AS place, '{m}' AS model, {v} AS f FROM p{h}, fit{h}" for k, (m, v) in enumerate(zip(MODELS, ["0.0::DOUBLE", "mean", *[f"intercept_{c} + slope_{c} * {c}" for c in LINES.values()]]))])
    return f"""dd{h} AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM rows0 WHERE target_{h} IS NOT NULL)), cuts{h} AS (SELECT max(day) FILTER (i = CAST(floor(n * 0.70::DOUBLE) AS INT)) AS v, max(day) FILTER (i = CAST(floor(n * 0.85::DOUBLE) AS INT)) AS t FROM dd{h}),
p{h} AS MATERIALIZED (SELECT rows0.*, CASE WHEN day < v - {h} THEN 'train' WHEN day >= v AND day < t - {h} THEN 'validation' WHEN day >= t THEN 'test' ELSE 'none' END AS part FROM rows0, cuts{h} WHERE target_{h} IS NOT NULL), fit{h} AS MATERIALIZED (SELECT avg(target_{h}) AS mean, {fits} FROM p{h} WHERE part = 'train'),
e{h} AS (SELECT {h} AS horizon, part, place, model, round(avg(abs(f - y)), 6) AS mae, count(f) AS n FROM ({values}) WHERE part IN ('validation', 'test') GROUP BY ALL)"""


CHAMPION = f"""{_split_sql(30)}, {_split_sql(90)}, errs AS MATERIALIZED (SELECT * FROM e30 UNION ALL SELECT * FROM e90),
best AS (SELECT horizon, arg_min(model, {{'mae': mae, 'place': place}}) AS model, min(mae) AS mae, min(mae) FILTER (place = 0) AS baseline_mae, count(*) AS candidates FROM errs WHERE part = 'validation' AND n > 0 AND mae IS NOT NULL GROUP BY horizon),
promoted AS MATERIALIZED (SELECT b.*, t.mae AS test_mae, t.n AS test_n, z.mae AS baseline_test_mae, CASE WHEN b.model LIKE '%baseline' THEN 'BASELINE_IS_BEST' WHEN coalesce(t.n, 0) = 0 THEN 'NO_TEST_ROWS' WHEN z.mae IS NULL THEN 'NO_BASELINE' WHEN NOT t.mae < z.mae THEN 'DOES_NOT_BEAT_BASELINE' ELSE 'PROMOTED' END AS reason
 FROM best b LEFT JOIN (SELECT * FROM errs WHERE part = 'test') t ON t.horizon = b.horizon AND t.model = b.model LEFT JOIN (SELECT * FROM errs WHERE part = 'test' AND place = 0) z ON z.horizon = b.horizon)"""


@query(f"{ROWS}, {CHAMPION} SELECT * EXCLUDE (place) FROM errs")
def candidate_errors(spark, sf):
    """Mean absolute errors of the candidates on unseen rows of each horizon."""
    return _errors(_kept_rows(spark, sf))[0].drop("place")


@query(f"{ROWS}, {CHAMPION} SELECT horizon, model, mae, baseline_mae, candidates, test_mae, test_n, baseline_test_mae, reason, reason = 'PROMOTED' AS approved FROM promoted")
def champion_choice(spark, sf):
    """The model of least validation error of each horizon, and whether the guard lets it through on the test rows."""
    return _promoted(_errors(_kept_rows(spark, sf))[0])


_FORECAST = " ".join(f"WHEN s.horizon = {h} AND pr.model = '{m}' THEN {v}" for h in HORIZONS for m, v in zip(MODELS, ["0.0::DOUBLE", f"(SELECT mean FROM fit{h})", *[f"(SELECT intercept_{c} FROM fit{h}) + (SELECT slope_{c} FROM fit{h}) * l.{c}" for c in LINES.values()]]))
RECORDS = f"""{SCEN}, {CHAMPION}, l AS (SELECT *, (SELECT max(day) FROM rows0) AS as_of FROM rows0 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY day DESC) = 1), hs AS (SELECT unnest([30, 90]) AS horizon),
r0 AS (SELECT l.ticker, s.horizon, l.day, l.price, CASE WHEN l.as_of - l.day > 10 THEN 'stale' WHEN x.status IS NULL THEN 'unavailable' WHEN x.status <> 'available' THEN 'insufficient_data' ELSE 'available' END AS status, x.base_return, x.lower_return, x.upper_return, pr.reason AS model_reason, pr.reason = 'PROMOTED' AS approved, pr.model, CASE {_FORECAST} END AS prediction
 FROM l CROSS JOIN hs s JOIN promoted pr ON pr.horizon = s.horizon LEFT JOIN scen x ON x.ticker = l.ticker AND x.horizon = s.horizon),
records AS (SELECT *, approved AND prediction IS NOT NULL AND status <> 'stale' AS usable FROM r0)"""


def _records(spark, sf) -> DataFrame:
    rows = _kept_rows(spark, sf)
    errors, fits = _errors(rows)
    promoted = written(_promoted(errors), "promoted")
    latest = rows.groupBy("ticker").agg(F.max_by(F.struct(*rows.columns), "day").alias("r")).select("r.*")  # a bar has a day of its own
    latest = written(latest, "latest")
    newest = rows.agg(F.max("day")).first()[0]  # each series' last bar is among its rows
    made = [latest.select("ticker", F.lit(h).alias("horizon"), F.explode(F.array(*_predictions(fits[h]))).alias("m")) for h in HORIZONS]
    named = promoted.select(F.col("horizon").alias("h"), F.col("model").alias("chosen"))
    predictions = reduce(DataFrame.unionByName, made).join(F.broadcast(named), (F.col("horizon") == F.col("h")) & (F.col("m.model") == F.col("chosen"))).select("ticker", "horizon", F.col("m.f").alias("prediction"))  # a row for each horizon
    return C.artifacts(latest.select("ticker", "day", F.lit(newest).alias("as_of"), "price"), _scenarios(spark, sf), predictions, promoted)


@query(f"""{RECORDS} SELECT ticker, horizon, day, price AS current_price, status, CASE status WHEN 'stale' THEN 'STALE_PRICES' WHEN 'unavailable' THEN 'NO_SCENARIO' WHEN 'insufficient_data' THEN 'INSUFFICIENT_SAMPLES' END AS reason, CASE WHEN status = 'available' THEN base_return END AS base_return, CASE WHEN usable THEN round(prediction, 6) END AS predicted_return, CASE WHEN usable THEN round(round(price * exp(prediction), 4), 2) END AS predicted_price,
 CASE WHEN approved THEN 'validated' ELSE 'not_promoted' END AS validation, model_reason, CASE WHEN usable THEN 'model' WHEN status = 'available' THEN 'scenario' ELSE 'unavailable' END AS display_source FROM records""")
def forecast_artifacts(spark, sf):
    """One record for each ticker and horizon, every field typed, nulls with a reason."""
    r = _records(spark, sf)
    return r.select("ticker", "horizon", "day", "current_price", "status", "reason", "scenario.base_return", F.round("forecast.predicted_return", 6).alias("predicted_return"), F.round("forecast.predicted_price", 2).alias("predicted_price"), "validation", "model_reason", "display_source")


_COUNT = ", ".join([f"count(*) FILTER (status = '{v}') AS n_{v}" for v in ("available", "insufficient_data", "stale", "unavailable")] + ["count(*) FILTER (usable) AS shown_model", "count(*) FILTER (NOT usable AND status = 'available') AS shown_scenario", "count(*) FILTER (NOT usable AND status <> 'available') AS shown_unavailable"])


@query(f"{RECORDS} SELECT horizon, count(*) AS records, {_COUNT} FROM records GROUP BY horizon")
def forecast_summary(spark, sf):
    return C.summary(_records(spark, sf))
