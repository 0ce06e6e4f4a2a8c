"""Time-series operators over price bars (ticker, day, idx, n, price, volume): windows per ticker, never across."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def by_day():
    return Window.partitionBy("ticker").orderBy("day")


def back(n: int) -> Column:
    return F.lag("price", n).over(by_day())


def n_return(n: int) -> Column:
    """Return over ``n`` sessions; null without them or from a price that isn't positive."""
    start = back(n)
    return F.when(start > 0, F.col("price") / start - 1)


def log_return() -> Column:
    prev = back(1)
    return F.when((prev > 0) & (F.col("price") > 0), F.ln(F.col("price") / prev))


def rolling_volatility(lr: str, n: int, least: int) -> Column:
    """Annualised deviation of the last ``n`` log returns, from ``least`` on."""
    w = by_day().rowsBetween(-(n - 1), 0)
    return F.when(F.count(lr).over(w) >= least, F.stddev_samp(lr).over(w) * F.sqrt(F.lit(252.0)))


def last_rows(bars: DataFrame, k: int) -> DataFrame:
    return bars.where(F.col("idx") >= F.col("n") - k)


def drawdown_last(bars: DataFrame, k: int) -> DataFrame:
    """(ticker, drawdown): lowest price against the running peak in the last ``k`` sessions, 0 at most."""
    peak = F.max("price").over(by_day().rowsBetween(Window.unboundedPreceding, 0))
    rows = last_rows(bars, k).withColumn("peak", peak)
    return rows.groupBy("ticker").agg(F.least(F.lit(0.0), F.min(F.col("price") / F.col("peak") - 1)).alias("drawdown"))


def rolling_drawdown(span: int) -> Column:
    """The same for each row over itself and the ``span`` rows before, folded over the frame's prices."""
    return drawdown_of(F.collect_list("price").over(by_day().rowsBetween(-span, 0)))


def drawdown_of(prices) -> Column:
    """Lowest price of an array against the peak before it, 0 at most."""
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst"))

    def step(acc, p):
        peak = F.greatest(acc["peak"], p)
        return F.struct(peak.alias("peak"), F.least(acc["worst"], p / peak - 1).alias("worst"))

    return F.aggregate(prices, start, step, lambda acc: acc["worst"])


def volume_trend() -> Column:
    """Mean volume of the last 21 sessions against the 21 before; null before session 42."""
    now, past = F.avg("volume").over(by_day().rowsBetween(-20, 0)), F.avg("volume").over(by_day().rowsBetween(-41, -21))
    return F.when((F.col("idx") >= 42) & (past > 0), now / past - 1)


def asof_backward(left: DataFrame, right: DataFrame, on: str = "day", value: str = "price", out: str = "asof") -> DataFrame:
    """Each left row with the right value of the latest day not after its own.

    Both sides go through one ordered window, bucketed by month so that no task
    holds all days: each month also gets the last value of the months before.
    """
    month = F.date_trunc("month", on).cast("date")
    r = right.select(F.col(on), F.col(value).alias("_v")).withColumn("_m", month)
    days = left.select(on).union(right.select(on)).distinct().withColumn("_m", month)
    ends = r.groupBy("_m").agg(F.max_by("_v", on).alias("_last"))
    months = days.select("_m").distinct().join(ends, "_m", "left")
    carried = months.withColumn("_before", F.last("_last", ignorenulls=True).over(Window.orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)))
    w = Window.partitionBy("_m").orderBy(on).rowsBetween(Window.unboundedPreceding, 0)
    known = days.join(r, [on, "_m"], "left").join(carried.select("_m", "_before"), "_m").withColumn(out, F.coalesce(F.last("_v", ignorenulls=True).over(w), F.col("_before")))
    return left.join(known.select(on, out), on, "left")


def target_after(days: int) -> Column:
    """Log return to the first later session at least ``days`` calendar days on; null if there is none.

    Days run backwards, so the frame only grows and its last row is the wanted one: linear in a series."""
    w = Window.partitionBy("ticker").orderBy(F.datediff("day", F.lit("1970-01-01").cast("date")).desc()).rangeBetween(Window.unboundedPreceding, -days)
    then = F.last("price").over(w)
    return F.when((then > 0) & (F.col("price") > 0), F.ln(then / F.col("price")))


def outcomes(horizons: tuple[int, ...]) -> Column:
    """Array of (horizon, outcome_day, outcome_price, low) of an entry at the next session, one for each horizon that the series reaches.

    ``low`` is the lowest price from the entry to the outcome; all are windows of the series, without a join."""
    found = []
    for h in horizons:
        low = F.min(F.when(F.col("price") > 0, F.col("price"))).over(by_day().rowsBetween(1, 1 + h))
        found.append(F.struct(F.lit(h).alias("horizon"), F.lead("day", 1 + h).over(by_day()).alias("outcome_day"), F.lead("price", 1 + h).over(by_day()).alias("outcome_price"), low.alias("low")))
    return F.filter(F.array(*found), lambda o: o["outcome_day"].isNotNull())


def snapshots(bars: DataFrame, step: int, first: int) -> DataFrame:
    """bars with ``is_snapshot``: every ``step``-th session from ``first``."""
    return bars.withColumn("is_snapshot", (F.col("idx") >= first) & ((F.col("idx") - first) % step == 0))
