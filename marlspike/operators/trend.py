"""Trend detector: robust line through the last 63 sessions' log prices, metrics, scores, status."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspike.functions.exprs import clamp, codes, ladder, ramp, share_of, weighted_mean

SPAN, RECENT = 63, 21
#: Fewer sessions of the series or of the benchmark are too few to judge.
LEAST = 50
#: Ties of a point with the line count as above it, within this distance.
TOUCH = 1e-9


def windows(bars: DataFrame, ends: DataFrame, span: int = SPAN + RECENT) -> DataFrame:
    """(ticker, e, points): for each wanted session ``ends(ticker, e)`` its last ``span`` prices in order.

    ``ends`` must be spaced widely, or few; each bar is copied to the ends it precedes.
    """
    near = bars.select("ticker", "idx", "price", "day").join(ends, "ticker").where("idx between e - %d and e" % (span - 1))
    return near.groupBy("ticker", "e").agg(F.array_sort(F.collect_list(F.struct("idx", "price"))).alias("points"), F.max("day").alias("day"))


def spaced_windows(bars: DataFrame, step: int, first: int, span: int = SPAN + RECENT, ahead: int = 0) -> DataFrame:
    """The same for every ``step``-th session from ``first`` with more than ``ahead`` after it: a bar goes to the few ends within ``span`` after it."""
    nth = F.sequence(F.greatest(F.ceil((F.col("idx") - first) / step), F.lit(0)).cast("int"), F.greatest(F.floor((F.col("idx") + span - 1 - first) / step), F.lit(-1)).cast("int"))
    nth = F.when(F.col("idx") + span - 1 >= first, nth).otherwise(F.array().cast("array<int>"))
    rows = bars.withColumn("k", F.explode(nth)).withColumn("e", F.col("k") * step + first).where(F.expr(f"e < n - {ahead} and idx <= e"))
    return rows.groupBy("ticker", "e").agg(F.array_sort(F.collect_list(F.struct("idx", "price"))).alias("points"), F.max("day").alias("day"))


METRICS = ["return21", "return63", "slope21", "slope63", "annualized63", "r2_63", "week_ratio", "residual_vol", "max_drawdown", "downside_vol", "excess21", "excess63", "acceleration", "largest_day", "above"]
#: A window is spiky where one day holds so much of the movement, or of the gain.
SPIKE_SHARE, SPIKE_GAIN = 0.35, 0.65


def theil_sen(lp: np.ndarray) -> dict[str, np.ndarray]:
    """Robust lines through rows of log prices: the median of all pairwise slopes, the median cut, and how well they fit."""
    n = lp.shape[1]
    if n < 2:
        return dict.fromkeys(("slope", "r2", "residual_vol", "above"), np.full(len(lp), np.nan))
    i, j = np.triu_indices(n, 1)
    slope = np.median((lp[:, j] - lp[:, i]) / (j - i), 1)
    line = slope[:, None] * np.arange(n)
    rest = lp - (np.median(lp - line, 1)[:, None] + line)
    rss, tss = (rest**2).sum(1), ((lp - lp.mean(1, keepdims=True)) ** 2).sum(1)
    r2 = np.where(tss == 0, (rss == 0).astype(float), np.clip(1 - rss / np.where(tss == 0, 1, tss), 0, 1))
    return {"slope": slope, "r2": r2, "residual_vol": rest.std(1, ddof=1), "above": (rest >= -TOUCH).mean(1)}


def _deviation(r: np.ndarray) -> np.ndarray:
    """Sample deviation of the negative log returns of each row; 0 with fewer than two."""
    below = r < 0
    k = below.sum(1)
    mean = np.where(below, r, 0).sum(1) / np.maximum(k, 1)
    return np.sqrt(np.where(below, (r - mean[:, None]) ** 2, 0).sum(1) / np.maximum(k - 1, 1)) * (k > 1)


def window_metrics(prices: np.ndarray) -> dict[str, np.ndarray]:
    """Metrics of windows of equally many prices (windows, sessions); NaN where a window is too short."""
    m, size = prices.shape
    last = prices[:, -SPAN:]
    lp = np.log(last)
    whole, recent, past = theil_sen(lp), theil_sen(lp[:, -RECENT:]), theil_sen(lp[:, : max(lp.shape[1] - RECENT, 0)])
    back = {n: prices[:, -1] / prices[:, -n - 1] - 1 if size > n else np.full(m, np.nan) for n in (RECENT, SPAN)}
    day = last[:, 1:] / last[:, :-1] - 1
    moved = np.abs(day).sum(1)
    weeks = np.arange(0, last.shape[1] - 5, 5)
    gain = last[:, -1] / last[:, 0] - 1
    best = np.maximum(day.max(1), 0) if day.shape[1] else np.full(m, np.nan)
    out = {
        "return21": back[RECENT], "return63": back[SPAN], "slope21": recent["slope"], "slope63": whole["slope"], "annualized63": np.exp(whole["slope"] * 252) - 1,
        "r2_63": whole["r2"], "week_ratio": (last[:, weeks + 5] > last[:, weeks]).mean(1) if len(weeks) else np.full(m, np.nan), "residual_vol": whole["residual_vol"],
        "max_drawdown": (last / np.maximum.accumulate(last, 1) - 1).min(1), "downside_vol": _deviation(np.diff(lp, axis=1)), "acceleration": recent["slope"] - past["slope"],
        "largest_day": np.where(moved > 0, np.abs(day).max(1, initial=0) / np.where(moved > 0, moved, 1), np.nan), "above": whole["above"],
    }
    rising = last[:, -1] > last[:, 0]
    out["spiky"] = np.nan_to_num(out["largest_day"]) >= SPIKE_SHARE
    out["spiky"] |= rising & (np.nan_to_num(best) / np.where(rising, gain, 1) >= SPIKE_GAIN)
    return out


def metrics(win: DataFrame, per: int = 256) -> DataFrame:
    """The 15 metrics (8 digits) of windows that also carry ``bench21``, ``bench63`` (bench returns) and ``bench_known`` (its sessions so far).

    One Arrow-batched step gives plain columns, so that a later filter on them
    is no copy of what they are made of. ``per`` windows of one length at a time.
    """
    rows = win.select("ticker", "e", "day", F.transform("points", lambda p: p["price"]).alias("prices"), F.col("bench21").cast("double"), F.col("bench63").cast("double"), F.col("bench_known").cast("int"))
    schema = rows.select("ticker", "e", "day", "bench_known").schema.add("sessions", "integer").add("spiky", "boolean")
    for c in METRICS:
        schema = schema.add(c, "double")

    def run(batches):
        for b in batches:
            column = b.column(3)
            size = np.diff(column.offsets.to_numpy())
            found = {c: np.full(b.num_rows, np.nan) for c in METRICS}
            spiky = np.zeros(b.num_rows, bool)
            flat = column.values.to_numpy(zero_copy_only=False)
            at = column.offsets.to_numpy()
            for n in np.unique(size[size > 0]):
                own = np.flatnonzero(size == n)
                for k in range(0, len(own), per):
                    part = own[k : k + per]
                    for c, v in window_metrics(flat[at[part][:, None] + np.arange(n)]).items():
                        (spiky if c == "spiky" else found[c])[part] = v
            bench = {n: b.column(c).to_numpy(zero_copy_only=False) for n, c in ((21, 4), (63, 5))}
            for n in (21, 63):
                found[f"excess{n}"] = found[f"return{n}"] - bench[n]
            cols = [pa.array(np.minimum(size, SPAN).astype(np.int32)), pa.array(spiky), *(pa.array(found[c], from_pandas=True) for c in METRICS)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(6), *cols], names=["ticker", "e", "day", "bench_known", "sessions", "spiky", *METRICS])

    out = rows.mapInArrow(run, schema)
    return out.select("ticker", "e", "day", "bench_known", "sessions", "spiky", *[F.round(c, 8).alias(c) for c in METRICS])


# Targets, ramps, weights and limits of the scores below, and the names of their reasons.
def scores(m: DataFrame) -> DataFrame:
    """Five sub-scores, the total (capped below emerging where one day dominates) and the status."""
    direction = weighted_mean([(share_of("annualized63", 0.35), 0.45), (share_of("return63", 0.12), 0.35), (share_of("return21", 0.03), 0.20)])
    consistency = weighted_mean([(ramp("r2_63", 0.25, 0.75), 0.35), (ramp("week_ratio", 0.45, 0.80), 0.30), (ramp("above", 0.45, 0.75), 0.15), (clamp(100.0 * (1.0 - F.col("residual_vol") / 0.055), 0, 100), 0.20)])
    relative = weighted_mean([(ramp("excess63", -0.08, 0.08), 0.65), (ramp("excess21", -0.04, 0.04), 0.35)])
    control = clamp(100.0 * (1.0 - F.abs("max_drawdown") / 0.30), 0, 100)
    confirm = weighted_mean([(share_of("return21", 0.03), 0.40), (share_of("slope21", 0.001), 0.40), (ramp("acceleration", -0.001, 0.001), 0.20)])
    parts = {"direction": direction, "consistency": consistency, "relative": relative, "drawdown_control": control, "confirmation": confirm}
    m = m.withColumns({k: F.round(v, 4) for k, v in parts.items()})
    total = F.round(weighted_mean([("direction", 0.30), ("consistency", 0.25), ("relative", 0.20), ("drawdown_control", 0.15), ("confirmation", 0.10)]), 4)
    m = m.withColumn("total", F.when(F.col("spiky"), F.least(total, F.lit(54.0))).otherwise(total))
    # a generator, so that a filter on what follows isn't rewritten in terms of all the sums above
    m = m.select(*[c for c in m.columns if c != "total"], F.explode(F.array("total")).alias("total"))
    rising = (F.col("slope63") > 0) & (F.col("return63") > 0) & ~F.col("spiky")
    detected = (F.col("total") >= 70) & rising & (F.col("return21") >= 0) & (F.col("r2_63") >= 0.45) & (F.col("week_ratio") >= 0.60) & (F.col("max_drawdown") >= -0.15)
    status = ladder([((F.col("sessions") < LEAST) | (F.col("bench_known") < LEAST) | F.col("total").isNull(), "unavailable"), (detected, "detected"), ((F.col("total") >= 55) & rising, "emerging")], "not_detected")
    m = m.withColumn("status", status)
    reasons = codes([
        (F.col("status") == "detected", "GROWTH_SPURT_DETECTED"), (F.col("status") == "emerging", "GROWTH_SPURT_EMERGING"), (F.col("sessions") < LEAST, "TREND_HISTORY_INSUFFICIENT"), ((F.col("sessions") >= LEAST) & (F.col("bench_known") < LEAST), "SPY_BENCHMARK_UNAVAILABLE"),
        ((F.col("slope63") > 0) & (F.col("annualized63") > 0.20), "TREND_SLOPE_STRONG"), ((F.col("r2_63") >= 0.45) & (F.col("week_ratio") >= 0.60), "TREND_CONSISTENCY_STRONG"),
        (F.col("relative") >= 60, "MARKET_RELATIVE_STRENGTH"), (F.col("relative") < 60, "TREND_WEAK_RELATIVE_TO_MARKET"), (F.col("max_drawdown") >= -0.08, "LOW_TREND_DRAWDOWN"),
        ((F.col("return21") >= 0) & (F.col("slope21") > 0), "RECENT_TREND_CONFIRMED"), (F.col("consistency") < 45, "TREND_TOO_VOLATILE"), (F.col("spiky"), "ONE_DAY_SPIKE_DOMINATED")])
    return m.withColumn("reason_codes", F.array_join(reasons, ",")).withColumn("score", F.round("total", 2))
