"""Queries over forecast rows: targets, split, baselines, scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlspike.operators import forecast as FC
from marlspike.operators import prices as P
from marlspike.sources.scratch import written

from .domain import BARS, bars
from .registry import query


def _r(c, d=6):
    return F.round(c, d)


ROWS = f"""WITH {BARS}, cut AS (SELECT ticker, day, price, volume, idx - greatest(n - 540, 0) AS idx FROM bars WHERE idx >= n - 540), lr2 AS (SELECT *, ln(price / lag(price) OVER w) AS lr FROM cut WINDOW w AS (PARTITION BY ticker ORDER BY day)),
feat0 AS (SELECT ticker, day, price, price / lag(price, 5) OVER w - 1 AS return_5, price / lag(price, 21) OVER w - 1 AS return_21, price / lag(price, 63) OVER w - 1 AS return_63,
 CASE WHEN idx >= 10 AND count(lr) OVER w21 >= 5 THEN stddev_samp(lr) OVER w21 * sqrt(252) END AS vol_21, CASE WHEN idx >= 42 THEN avg(volume) OVER w21 / avg(volume) OVER (PARTITION BY ticker ORDER BY day ROWS BETWEEN 41 PRECEDING AND 21 PRECEDING) - 1 END AS volume_trend, day + 30 AS d30, day + 90 AS d90
 FROM lr2 WINDOW w AS (PARTITION BY ticker ORDER BY day), w21 AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
t30 AS (SELECT f.*, b.price AS p30 FROM feat0 f ASOF LEFT JOIN cut b ON f.ticker = b.ticker AND f.d30 <= b.day), t90 AS (SELECT f.*, b.price AS p90 FROM t30 f ASOF LEFT JOIN cut b ON f.ticker = b.ticker AND f.d90 <= b.day),
rows0 AS MATERIALIZED (SELECT *, ln(p30 / price) AS target_30, ln(p90 / price) AS target_90 FROM t90)"""
SPLIT = ROWS + """, dd AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM rows0 WHERE target_30 IS NOT NULL)), cuts AS (SELECT max(day) FILTER (i = CAST(floor(n * 0.70::DOUBLE) AS INT)) AS v, max(day) FILTER (i = CAST(floor(n * 0.85::DOUBLE) AS INT)) AS t FROM dd),
parts AS MATERIALIZED (SELECT rows0.*, CASE WHEN day < v - 30 THEN 'train' WHEN day >= v AND day < t - 30 THEN 'validation' WHEN day >= t THEN 'test' ELSE 'none' END AS part FROM rows0, cuts WHERE target_30 IS NOT NULL)"""
_COLS = ["return_5", "return_21", "return_63", "volume_trend", "target_30", "target_90"]


def _rows(spark, sf) -> DataFrame:
    return FC.training_rows(bars(spark, sf))


def _kept_rows(spark, sf) -> DataFrame:
    """The rows as a table, for what reads them more than once."""
    return written(_rows(spark, sf), "rows")


def _parts(spark, sf) -> DataFrame:
    return FC.split(_kept_rows(spark, sf), "target_30", 30)


@query(ROWS + f" SELECT ticker, day, {', '.join(f'round({c}, 6) AS {c}' for c in _COLS)}, round(vol_21, 5) AS vol_21 FROM rows0")
def training_rows(spark, sf):
    return _rows(spark, sf).select("ticker", "day", *[_r(c).alias(c) for c in _COLS], _r("vol_21", 5).alias("vol_21"))


@query(SPLIT + " SELECT part, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM parts GROUP BY part")
def temporal_split_embargo(spark, sf):
    return _parts(spark, sf).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query(SPLIT + """, m AS (SELECT avg(target_30) AS mean FROM parts WHERE part = 'train'), p AS (SELECT part, target_30 AS y, mean AS f FROM parts, m WHERE part IN ('validation', 'test'))
SELECT part, count(*) AS n, round(avg(abs(f - y)), 5) AS mae, round(sqrt(avg((f - y) * (f - y))), 5) AS rmse, round(median(abs(f - y)), 5) AS median_ae, round(avg(CASE WHEN sign(f) = sign(y) THEN 1.0::DOUBLE ELSE 0 END), 5) AS sign_accuracy, round(avg(f - y), 5) AS bias FROM p GROUP BY part""")
def baseline_model_metrics(spark, sf):
    p = _parts(spark, sf)
    mean = p.where("part = 'train'").agg(F.avg("target_30")).first()[0]
    return FC.error_metrics(p.where("part in ('validation', 'test')").withColumn("f", F.lit(mean)), "target_30", "f", ["part"])


@query(SPLIT + ", x AS (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY round(return_21, 8), day) AS a, row_number() OVER (PARTITION BY ticker ORDER BY round(target_30, 8), day) AS b FROM parts WHERE return_21 IS NOT NULL) SELECT ticker, round(corr(a, b), 5) AS spearman FROM x GROUP BY ticker")
def spearman_ordinal(spark, sf):
    p = _parts(spark, sf).where("return_21 is not null")
    rank = lambda c: F.row_number().over(Window.partitionBy("ticker").orderBy(F.round(c, 8), "day"))
    return p.select("ticker", rank("return_21").alias("a"), rank("target_30").alias("b")).groupBy("ticker").agg(_r(F.corr("a", "b"), 5).alias("spearman"))


@query(SPLIT + ", m AS (SELECT avg(target_30) AS mean FROM parts WHERE part = 'train') SELECT ticker, round(quantile_cont(target_30 - mean, 0.1), 5) AS p10, round(quantile_cont(target_30 - mean, 0.9), 5) AS p90 FROM parts, m WHERE part = 'validation' GROUP BY ticker")
def residual_quantiles(spark, sf):
    p = _parts(spark, sf)
    mean = p.where("part = 'train'").agg(F.avg("target_30")).first()[0]
    g = p.where("part = 'validation'").withColumn("e", F.col("target_30") - F.lit(mean)).groupBy("ticker").agg(F.expr("percentile(e, array(0.1D, 0.9D))").alias("q"))
    return g.select("ticker", _r(F.col("q")[0], 5).alias("p10"), _r(F.col("q")[1], 5).alias("p90"))


@query(f"WITH {BARS}, s AS (SELECT ticker, price, ln(price / lag(price, 30) OVER (PARTITION BY ticker ORDER BY day)) AS g, idx, n FROM bars), c AS (SELECT ticker, price, greatest(ln(0.05::DOUBLE), least(ln(3.0::DOUBLE), g)) AS b, greatest(ln(0.05::DOUBLE), least(ln(3.0::DOUBLE), g - 0.1::DOUBLE)) AS l, greatest(ln(0.05::DOUBLE), least(ln(3.0::DOUBLE), g + 0.1::DOUBLE)) AS u FROM s WHERE idx = n - 1) SELECT ticker, round(exp(l) - 1, 6) AS lower_return, round(exp(b) - 1, 6) AS base_return, round(exp(u) - 1, 6) AS upper_return, round(price * exp(b), 4) AS price FROM c")
def return_bundle(spark, sf):
    import math

    b = bars(spark, sf).withColumn("g", F.ln(F.col("price") / P.back(30))).where("idx = n - 1")
    clip = lambda c: F.greatest(F.lit(math.log(0.05)), F.least(F.lit(math.log(3.0)), c))
    trio = F.array_sort(F.array(*[F.exp(clip(F.col("g") + d)) - 1 for d in (-0.1, 0.0, 0.1)]))
    b = b.withColumn("t", trio)
    return b.select("ticker", *[_r(F.col("t")[i]).alias(n) for i, n in enumerate(("lower_return", "base_return", "upper_return"))], _r(F.col("price") * (1 + F.col("t")[1]), 4).alias("price"))


def _scenario_sql(h: int) -> str:
    least, shrink, cap = FC.SCENARIO[h]
    return f"""sc{h} AS (SELECT ticker, count(*) AS n, median(r) * (count(*) / (count(*) + {shrink}::DOUBLE)) AS b, quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.75) AS q3, any_value(cur) AS cur FROM (SELECT ticker, exp(target_{h}) - 1 AS r, cur FROM smp WHERE target_{h} IS NOT NULL) GROUP BY ticker),
so{h} AS (SELECT ticker, {h} AS horizon, n, CASE WHEN n >= {least} THEN round(greatest(-{cap}::DOUBLE, least({cap}::DOUBLE, b)), 6) END AS base_return, CASE WHEN n >= {least} THEN round(greatest(-{cap}::DOUBLE, least({cap}::DOUBLE, least(q1, b))), 6) END AS lower_return, CASE WHEN n >= {least} THEN round(greatest(-{cap}::DOUBLE, least({cap}::DOUBLE, greatest(q3, b))), 6) END AS upper_return,
 CASE WHEN n >= {least} THEN 'available' ELSE 'insufficient_data' END AS status, cur FROM sc{h})"""


SCEN = ROWS + f", smp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day) AS k, last_value(price) OVER (PARTITION BY ticker ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS cur FROM rows0) WHERE (k - 1) % 21 = 0), {_scenario_sql(30)}, {_scenario_sql(90)}, scen AS (SELECT * FROM so30 UNION ALL SELECT * FROM so90)"""


def _scenarios(spark, sf) -> DataFrame:
    w = Window.partitionBy("ticker")
    s = _rows(spark, sf).select("ticker", "day", "price", "target_30", "target_90").withColumn("k", F.row_number().over(w.orderBy("day"))).withColumn("current", F.max_by("price", "day").over(w)).where("(k - 1) % 21 = 0")
    s = written(s.select("ticker", "current", "target_30", "target_90"), "samples")
    one = lambda h: FC.scenario(s.select("ticker", "current", (F.exp(f"target_{h}") - 1).alias("r")), h).withColumn("horizon", F.lit(h))
    return one(30).unionByName(one(90))


@query(SCEN + " SELECT ticker, horizon, n, base_return, lower_return, upper_return, status, round(cur * (1 + base_return), 4) AS price FROM scen")
def scenario_30_90(spark, sf):
    return _scenarios(spark, sf)


@query(f"WITH {BARS}, l AS (SELECT ticker, max(day) AS as_of FROM bars GROUP BY 1) SELECT ticker, as_of, (SELECT max(day) FROM bars) - as_of > 10 AS stale FROM l")
def scenario_staleness(spark, sf):
    last = bars(spark, sf).groupBy("ticker").agg(F.max("day").alias("as_of"))
    newest = last.agg(F.max("as_of")).first()[0]
    return last.withColumn("stale", F.datediff(F.lit(newest), "as_of") > 10)


@query(SCEN + " SELECT ticker, horizon, CASE WHEN ticker % 5 = 0 THEN 'model' WHEN status = 'available' THEN 'scenario' ELSE 'unavailable' END AS source FROM scen")
def display_source(spark, sf):
    return _scenarios(spark, sf).select("ticker", "horizon", FC.display_source(F.col("ticker") % 5 == 0, F.col("status")).alias("source"))


@query(ROWS + " SELECT count(DISTINCT ticker) AS tickers, count(*) AS n, count(target_30) AS labelled_30, round(avg(CASE WHEN return_63 IS NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS missing_63, min(day) AS first_day, max(day) AS last_day FROM rows0")
def quality_report(spark, sf):
    return _rows(spark, sf).agg(F.countDistinct("ticker").alias("tickers"), F.count(F.lit(1)).alias("n"), F.count("target_30").alias("labelled_30"), _r(F.avg(F.col("return_63").isNull().cast("double"))).alias("missing_63"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query(SCEN + " SELECT ticker, horizon FROM scen WHERE status = 'available' AND NOT (lower_return <= base_return AND base_return <= upper_return)")
def audit_forecast(spark, sf):
    return _scenarios(spark, sf).where("status = 'available' and not (lower_return <= base_return and base_return <= upper_return)").select("ticker", "horizon")


@query()
def ml_leaderboard(spark, sf):
    return FC.leaderboard(_parts(spark, sf), "target_30", ["return_5", "return_21", "return_63", "vol_21", "volume_trend"])
