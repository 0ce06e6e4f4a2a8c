"""Choosing a model for each horizon, guarding its promotion, keeping it, and the artifacts made of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Typed fields of a model's forecast, null where there is none (fixed names).
PREDICTED = "struct<predicted_return:double,predicted_price:double,model:string>"
TARGET = "struct<base_return:double,lower_return:double,upper_return:double,price:double>"


def argmin_model(errors: DataFrame, keys: list[str] = ("horizon",), baseline: str = "zero-return baseline") -> DataFrame:
    """Per key of ``errors(keys, model, place, mae, n)``: the model of least error, the first by ``place`` of several alike.

    Models without an error (null or no number, or no rows) are no candidates. ``baseline_mae`` is the baseline's."""
    usable = F.col("mae").isNotNull() & ~F.isnan("mae") & (F.col("n") > 0)
    best = F.min(F.when(usable, F.struct("mae", "place", "model")))
    return errors.groupBy(*keys).agg(best.alias("b"), F.min(F.when(usable & (F.col("model") == baseline), F.col("mae"))).alias("baseline_mae"), F.count_if(usable).alias("candidates")).select(
        *keys, F.col("b.model").alias("model"), F.col("b.mae").alias("mae"), "baseline_mae", "candidates")


def promotion(chosen: DataFrame, tests: DataFrame, keys: list[str] = ("horizon",), baseline: str = "zero-return baseline") -> DataFrame:
    """``chosen`` with ``approved`` and a ``reason``: on unseen rows, ``tests(keys, model, mae, bias, sign_accuracy, n)``, the model must beat the baseline.

    A baseline is never promoted, nor a model without test rows, nor one that a baseline ties with."""
    t = tests.select(*keys, "model", F.col("mae").alias("test_mae"), F.col("n").alias("test_n"))
    base = tests.where(F.col("model") == baseline).select(*keys, F.col("mae").alias("baseline_test_mae"))
    rows = chosen.join(t, [*keys, "model"], "left").join(base, [*keys], "left")
    reason = (F.when(F.col("model").isNull(), "NO_CANDIDATE").when(F.col("model").endswith("baseline"), "BASELINE_IS_BEST").when(F.coalesce("test_n", F.lit(0)) == 0, "NO_TEST_ROWS")
              .when(F.col("baseline_test_mae").isNull(), "NO_BASELINE").when(~(F.col("test_mae") < F.col("baseline_test_mae")), "DOES_NOT_BEAT_BASELINE").otherwise("PROMOTED"))
    return rows.withColumn("reason", reason).withColumn("approved", F.col("reason") == "PROMOTED")


@dataclass
class Model:
    """A kept model: a constant, a fitted pipeline, or none, which predicts null."""

    name: str
    value: float | None = None
    fitted: object = None

    def predict(self, rows: DataFrame, out: str = "prediction") -> DataFrame:
        """``rows`` with the prediction; rows in which a fitted pipeline finds no number stay, with null."""
        if self.fitted is None:
            return rows.withColumn(out, F.lit(self.value).cast("double"))
        done = self.fitted.transform(rows)
        value = F.col("prediction").cast("double")
        return done.select(*[F.col(c) for c in rows.columns if c != out], F.when(~F.isnan(value), value).alias(out))

    def save(self, spark, path: str) -> None:
        """The name and constant as a row, the pipeline beside it."""
        spark.createDataFrame([(self.name, self.value, self.fitted is not None)], "name string, value double, fitted boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
        if self.fitted is not None:
            self.fitted.write().overwrite().save(f"{path}/pipeline")

    @classmethod
    def load(cls, spark, path: str) -> Model:
        from pyspark.ml import PipelineModel

        row = spark.read.parquet(f"{path}/model").first()
        return cls(row["name"], row["value"], PipelineModel.load(f"{path}/pipeline") if row["fitted"] else None)


def validation_status(approved: Column, model: Column) -> Column:
    return F.when(approved, "validated").when(model.isNotNull(), "not_promoted").otherwise("not_evaluated")


def artifacts(latest: DataFrame, scenarios: DataFrame, predictions: DataFrame | None, promoted: DataFrame, stale_after: int = 10) -> DataFrame:
    """One record for each (ticker, horizon): ``latest(ticker, day, as_of, price)`` with its scenario, model and what is shown.

    ``scenarios(ticker, horizon, status, base_return, lower_return, upper_return, price)``, ``predictions(ticker, horizon,
    prediction)``, ``promoted(horizon, model, approved, reason)``. Every record has every field: what isn't there is a typed
    null with a reason (STALE_PRICES, NO_SCENARIO, INSUFFICIENT_SAMPLES, and the guard's)."""
    stale = F.datediff("as_of", "day") > stale_after
    rows = latest.crossJoin(F.broadcast(promoted.select("horizon", "model", "approved", F.col("reason").alias("model_reason"))))  # a row for each horizon
    s = scenarios.select("ticker", "horizon", F.col("status").alias("_status"), F.struct("base_return", "lower_return", "upper_return", F.col("price").alias("price")).cast(TARGET).alias("_scenario"))
    rows = rows.join(s, ["ticker", "horizon"], "left")
    if predictions is not None:
        rows = rows.join(predictions.select("ticker", "horizon", "prediction"), ["ticker", "horizon"], "left")
    else:
        rows = rows.withColumn("prediction", F.lit(None).cast("double"))
    status = F.when(stale, "stale").when(F.col("_status").isNull(), "unavailable").when(F.col("_status") != "available", "insufficient_data").otherwise("available")
    rows = rows.withColumn("status", status)
    reason = F.when(F.col("status") == "stale", "STALE_PRICES").when(F.col("status") == "unavailable", "NO_SCENARIO").when(F.col("status") == "insufficient_data", "INSUFFICIENT_SAMPLES")
    usable = F.col("approved") & F.col("prediction").isNotNull() & (F.col("status") != "stale")
    model = F.when(usable, F.struct(F.col("prediction").alias("predicted_return"), F.round(F.col("_latest") * F.exp("prediction"), 4).alias("predicted_price"), F.col("model").alias("model")).cast(PREDICTED)).otherwise(F.lit(None).cast(PREDICTED))
    rows = rows.withColumnRenamed("price", "_latest").withColumn("scenario", F.when(F.col("status") == "available", F.col("_scenario")).otherwise(F.lit(None).cast(TARGET)))
    shown = F.when(usable, "model").when(F.col("status") == "available", "scenario").otherwise("unavailable")
    return rows.select("ticker", "horizon", "day", F.col("_latest").alias("current_price"), "status", reason.alias("reason"), "scenario", model.alias("forecast"), validation_status(F.col("approved"), F.col("model")).alias("validation"), "model_reason", shown.alias("display_source"))


def summary(records: DataFrame) -> DataFrame:
    """Per horizon how many records there are of each status and source."""
    count = lambda c, v: F.count_if(F.col(c) == v).alias(f"n_{v}")
    return records.groupBy("horizon").agg(F.count(F.lit(1)).alias("records"), *[count("status", v) for v in ("available", "insufficient_data", "stale", "unavailable")], *[F.count_if(F.col("display_source") == v).alias(f"shown_{v}") for v in ("model", "scenario", "unavailable")])
