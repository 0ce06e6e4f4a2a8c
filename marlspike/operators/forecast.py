"""Forecast rows, temporal split with embargo, baseline leaderboard, scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspike.functions.exprs import clamp
from marlspike.sources.scratch import written

from . import prices as P

# Fixed values per horizon in days: least samples, shrinkage constant, cap.
SCENARIO = {30: (24, 24, 0.08), 90: (12, 18, 0.15)}


def training_rows(bars: DataFrame, last: int = 540) -> DataFrame:
    """Features and calendar targets of the last ``last`` sessions of each series."""
    b = P.last_rows(bars, last).withColumn("idx", F.col("idx") - F.greatest(F.col("n") - last, F.lit(0)))
    b = b.withColumn("lr", P.log_return())
    cols = {"return_5": P.n_return(5), "return_21": P.n_return(21), "return_63": P.n_return(63), "vol_21": F.when(F.col("idx") >= 10, P.rolling_volatility("lr", 21, 5)), "volume_trend": P.volume_trend(), "target_30": P.target_after(30), "target_90": P.target_after(90)}
    return b.select("ticker", "day", "price", *[c.alias(n) for n, c in cols.items()])


def split(rows: DataFrame, target: str, days: int) -> DataFrame:
    """Adds ``part``: train, validation, test or none. Cuts at 70 and 85 percent of the distinct labelled days, less the horizon."""
    labelled = rows.where(F.col(target).isNotNull())
    days_of = labelled.select("day").distinct().withColumn("i", F.row_number().over(Window.orderBy("day")) - 1)  # calendar days, not rows
    n = days_of.count()
    if n < 90:
        return labelled.withColumn("part", F.lit("test"))
    cut = {r["i"]: r["day"] for r in days_of.where(F.col("i").isin(int(n * 0.70), int(n * 0.85))).collect()}
    v, t = F.lit(cut[int(n * 0.70)]), F.lit(cut[int(n * 0.85)])
    part = F.when(F.col("day") < F.date_sub(v, days), "train").when((F.col("day") >= v) & (F.col("day") < F.date_sub(t, days)), "validation").when(F.col("day") >= t, "test").otherwise("none")
    return labelled.withColumn("part", part)


def error_metrics(rows: DataFrame, actual: str, predicted: str, keys: list[str]) -> DataFrame:
    e = F.col(predicted) - F.col(actual)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(e)), 5).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 5).alias("rmse"), F.round(F.median(F.abs(e)), 5).alias("median_ae"), F.round(F.avg((F.signum(predicted) == F.signum(actual)).cast("double")), 5).alias("sign_accuracy"), F.round(F.avg(e), 5).alias("bias"))


def scenario(samples: DataFrame, horizon: int) -> DataFrame:
    """Per ticker from returns ``r`` and the current price: shrunken median between quartiles, capped, or insufficient."""
    least, shrink, cap = SCENARIO[horizon]
    g = samples.where("r is not null").groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.expr("percentile(r, array(0.25D, 0.5D, 0.75D))").alias("q"), F.first("current").alias("current"))
    base = F.col("q")[1] * (F.col("n") / (F.col("n") + float(shrink)))
    g = g.withColumn("b", base).withColumn("lo", F.least(F.col("q")[0], F.col("b"))).withColumn("hi", F.greatest(F.col("q")[2], F.col("b")))
    ok = F.col("n") >= least
    out = {k: F.when(ok, F.round(clamp(c, -cap, cap), 6)) for k, c in (("base_return", "b"), ("lower_return", "lo"), ("upper_return", "hi"))}
    g = g.select("ticker", "n", "current", *[c.alias(k) for k, c in out.items()], F.when(ok, "available").otherwise("insufficient_data").alias("status"))
    return g.withColumn("price", F.round(F.col("current") * (1 + F.col("base_return")), 4)).drop("current")


def display_source(approved: Column, scenario_status: Column) -> Column:
    return F.when(approved, "model").when(scenario_status == "available", "scenario").otherwise("unavailable")


def leaderboard(rows: DataFrame, target: str, features: list[str], seed: int = 7) -> DataFrame:
    """(model, mae) on the validation part of constants, ridge, elastic net, Huber, boosted trees and a forest, with median imputation and scaling."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    held = written(rows.where("part in ('train', 'validation')").select("part", target, *features), "leaderboard-rows")
    train = held.where("part = 'train'")
    mean = train.agg(F.avg(target)).first()[0] or 0.0
    guesses = {"zero-return baseline": F.lit(0.0), "historical-mean baseline": F.lit(mean), "market-return baseline": F.lit(mean)}
    prepare = [Imputer(strategy="median", inputCols=features, outputCols=[f"i_{f}" for f in features]), VectorAssembler(inputCols=[f"i_{f}" for f in features], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True)]
    kinds = {"ridge": LinearRegression(featuresCol="x", labelCol=target, regParam=0.1, maxIter=20), "elastic-net": LinearRegression(featuresCol="x", labelCol=target, regParam=0.01, elasticNetParam=0.5, maxIter=20), "huber": LinearRegression(featuresCol="x", labelCol=target, loss="huber", maxIter=20),
             "gradient-boosting": GBTRegressor(featuresCol="x", labelCol=target, maxIter=5, maxDepth=3, seed=seed), "random-forest": RandomForestRegressor(featuresCol="x", labelCol=target, numTrees=10, maxDepth=4, seed=seed)}
    # prepared once, and every model predicts in one pass over the validation rows
    ready = written(Pipeline(stages=prepare).fit(train).transform(held).select("part", target, "x"), "leaderboard-prepared")
    learnt, test = ready.where("part = 'train'"), ready.where("part = 'validation'")
    for name, model in kinds.items():
        test = model.setPredictionCol(name).fit(learnt).transform(test)
        guesses[name] = F.col(f"`{name}`")
    means = test.agg(*[F.avg(F.abs(F.col(target) - g)).alias(n) for n, g in guesses.items()])
    return means.select(F.inline(F.array(*[F.struct(F.lit(n).alias("model"), F.round(f"`{n}`", 6).alias("mae")) for n in guesses])))
