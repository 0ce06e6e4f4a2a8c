"""State of a pipeline run: normalised failures, eight stages, the overall verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspike.functions.exprs import ladder

# Reason codes of failure messages, first match wins.
RETRYABLE_STATUS = "HTTP Error (429|500|502|503|504)"


def failure(message: Column) -> Column:
    """(reason, retryable) of a failure's message."""
    text = F.coalesce(message, F.lit(""))
    low = F.lower(text)
    reason = ladder([
        (text.contains("HTTP Error 404"), "PROVIDER_HTTP_404"), (text.rlike(RETRYABLE_STATUS), "PROVIDER_RETRYABLE_HTTP_ERROR"), (low.contains("companyfacts"), "SEC_COMPANYFACTS_UNAVAILABLE"),
        (low.contains("price") | low.contains("chart"), "PRICE_HISTORY_UNAVAILABLE"), (low.contains("cik"), "TICKER_CIK_MAPPING_MISSING")], "PROVIDER_REQUEST_FAILED")
    return F.struct(reason.alias("reason"), (~reason.isin("PROVIDER_HTTP_404", "TICKER_CIK_MAPPING_MISSING")).alias("retryable"))


def histogram(failures: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, reason, retryable, n, place): reasons by how common they are; ties by name."""
    counted = failures.withColumn("f", failure(F.col("message"))).groupBy(*keys, "f.reason", "f.retryable").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "reason")))


def _stage(name: str, status: Column, attempted, succeeded, failed, skipped, reasons: Column) -> Column:
    n = lambda c: (F.lit(c) if isinstance(c, int) else c).cast("long")
    return F.struct(F.lit(name).alias("name"), status.alias("status"), n(attempted).alias("attempted"), n(succeeded).alias("succeeded"), n(failed).alias("failed"), n(skipped).alias("skipped"), n(reasons).alias("reasons"))


def stages(runs: DataFrame) -> DataFrame:
    """(run, name, status, attempted, succeeded, failed, skipped, reasons) of the eight stages of each run.

    ``runs``: run, core_expected, core_missing, etl_requested, etl_succeeded, etl_failed, backtest_skipped, backtest_complete, backtest_snapshots,
    backtest_observations, forecasts, forecasts_unavailable, forecasts_short, search_docs, search_tickers, balance_available, balance_partial,
    balance_unavailable, balance_fallback, trend_mode, trend_attempted, trend_judged, trend_unavailable, trend_failures.
    ``reasons`` adds up the counts of a stage's reasons.
    """
    c = F.col
    balance = c("balance_available") + c("balance_partial") + c("balance_unavailable")
    off = c("trend_mode") == "off"
    found = [
        _stage("core_artifacts", F.when(c("core_missing") > 0, "failed").otherwise("success"), c("core_expected"), c("core_expected") - c("core_missing"), c("core_missing"), 0, c("core_missing")),
        _stage("etl_ticker_pipeline", F.when((c("etl_requested") > 0) & (c("etl_failed") == 0), "success").when((c("etl_requested") > 0) & (c("etl_succeeded") > 0), "partial_success").otherwise("failed"), c("etl_requested"), c("etl_succeeded"), c("etl_failed"), 0, c("etl_failed")),
        _stage("backtest", F.when(c("backtest_skipped"), "unavailable_expected").when(c("backtest_complete"), "success").otherwise("partial_success"), c("backtest_snapshots"), c("backtest_observations"), 0, c("backtest_skipped").cast("int"), c("backtest_skipped").cast("int")),
        _stage("forecast_artifacts", F.when(c("forecasts") == 0, "failed").otherwise("success"), c("forecasts"), F.greatest(F.lit(0), c("forecasts") - c("forecasts_unavailable")), 0, c("forecasts_unavailable"), c("forecasts_short") + c("forecasts_unavailable")),
        _stage("filing_search_index", F.when((c("search_docs") > 0) & (c("search_tickers") > 0), "success").otherwise("failed"), c("search_tickers"), c("search_tickers"), ((c("search_docs") == 0) | (c("search_tickers") == 0)).cast("int"), 0, (c("search_docs") == 0).cast("int")),
        _stage("balance_sheet_context", F.when(c("balance_partial") + c("balance_unavailable") > 0, "partial_success").otherwise("success"), F.when(balance > 0, balance).otherwise(c("balance_fallback")), c("balance_available") + c("balance_partial"), 0, c("balance_unavailable"), c("balance_partial") + c("balance_unavailable")),
        _stage("growth_spurt_detector", F.when(off, "unavailable_expected").when(c("trend_attempted") == 0, "failed").when(c("trend_failures") > 0, "partial_success").otherwise("success"), F.when(off, 0).otherwise(c("trend_attempted")), F.when(off, 0).otherwise(c("trend_judged")),
               F.when(off, 0).otherwise(c("trend_failures")), F.when(off, 1).otherwise(c("trend_unavailable")), F.when(off, 1).otherwise(c("trend_unavailable") + c("trend_failures"))),
        _stage("market_targets", F.lit("unavailable_expected"), c("forecasts"), 0, 0, c("forecasts"), F.greatest(c("forecasts"), F.lit(1))),
    ]
    return runs.select("run", F.inline(F.array(*found)))


def overall(stage_rows: DataFrame) -> DataFrame:
    """(run, status, readiness, critical, noncritical, expected_unavailable, quality_warnings, warnings): any failed stage blocks, failed tickers limit."""
    is_ = lambda name: F.col("name") == name
    total = lambda test, c: F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0))
    soft = (F.col("status") == "partial_success") & (F.col("failed") == 0)
    g = stage_rows.groupBy("run").agg(
        F.max(F.col("status") == "failed").alias("any_failed"), total(is_("etl_ticker_pipeline"), "failed").alias("etl_failed"), total(is_("core_artifacts"), "failed").alias("critical"), total(~is_("core_artifacts"), "failed").alias("noncritical"),
        total(F.col("status") == "unavailable_expected", "skipped").alias("expected_unavailable"), total(soft, "reasons").alias("quality_warnings"), total(soft | (F.col("status") == "failed"), "reasons").alias("warnings"))
    status = F.when((F.col("critical") > 0) | F.col("any_failed"), "failed").when(F.col("etl_failed") > 0, "partial_success").otherwise("success")
    g = g.withColumn("status", status).withColumn("readiness", F.when(F.col("status") == "failed", "blocked").when(F.col("status") == "partial_success", "ready_with_known_limitations").otherwise("ready"))
    return g.select("run", "status", "readiness", "critical", "noncritical", "expected_unavailable", "quality_warnings", "warnings")


def complete_batch(status: Column, attempted: Column, processed: Column) -> Column:
    """A batch is complete by its status or, without one, once as many keys were processed as attempted."""
    return F.when(status == "complete", True).when(status == "partial", False).otherwise((attempted > 0) & (processed >= attempted))


def checkpoint_gate(batches: DataFrame, selected: int, size: int) -> DataFrame:
    """One row for ``batches(start, status, attempted, succeeded, failed)``: how far the expected ranges are there, and whether all are."""
    spark = batches.sparkSession
    expected = spark.range(0, max(selected, 0), size).select(F.col("id").alias("start"))
    done = complete_batch(F.col("status"), F.col("attempted"), F.col("succeeded") + F.col("failed"))
    known = batches.select("start", done.alias("done"), "attempted", "succeeded", "failed", F.lit(True).alias("there"))
    j = expected.withColumn("expected", F.lit(True)).join(known, "start", "full_outer")
    here = F.col("expected") & F.col("there")
    total = lambda test, c: F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0))
    g = j.agg(F.count("expected").alias("expected"), F.count_if(here & F.col("done")).alias("completed"), F.count_if(F.col("there").isNull()).alias("missing"), F.count_if(F.col("expected").isNull()).alias("unexpected"),
              total(here & F.col("done"), "attempted").alias("attempted"), total(here & F.col("done"), "succeeded").alias("succeeded"), total(here, "failed").alias("failed"))
    return g.withColumn("complete", (F.col("missing") == 0) & (F.col("completed") >= F.col("expected")) & (F.col("attempted") >= selected))


def require_complete(gate: DataFrame, allow_partial: bool = False) -> None:
    """Raise where the gate is not passed."""
    row = gate.first()
    if not row["complete"] and not allow_partial:
        raise RuntimeError(f"{row['missing']} batches are missing and {row['completed']} of {row['expected']} complete; a partial merge must be asked for")


def coverage(rows: DataFrame) -> DataFrame:
    """One row of fourteen counts over ``rows(cik, exchange, exclude_reason, annual, quarterly, downloaded, indexed, companyfacts, confidence, failed)``."""
    c = F.col
    n = {
        "listed": F.upper("exchange").isin("NYSE", "NASDAQ"), "supported": c("exclude_reason").isNull(), "recent_annual": c("annual"), "recent_quarterly": c("quarterly"), "downloaded": c("downloaded"), "indexed": c("indexed"), "searchable": c("indexed"),
        "companyfacts": c("companyfacts"), "scoreable": c("confidence") != "Insufficient", "insufficient": c("confidence") == "Insufficient", "unsupported": c("exclude_reason").isNotNull(), "failed": c("failed"),
    }
    return rows.agg(F.count(F.lit(1)).alias("raw_symbols"), F.countDistinct("cik").alias("unique_ciks"), *[F.count_if(v).alias(k) for k, v in n.items()])
