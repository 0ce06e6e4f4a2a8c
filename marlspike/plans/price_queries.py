"""Queries over price series: returns, risk, as-of joins, the trend detector and event studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlspike.operators import prices as P
from marlspike.operators import trend as T
from marlspike.operators.ranks import average_rank
from marlspike.sources.scratch import written

from .domain import BARS, BENCH, SECURITIES, bars, benchmark_bars, securities
from .registry import query


def _r(c, d: int = 6):
    return F.round(c, d)


# Sessions after which the trend detector's signals are judged, and what makes one a false positive.
AFTER = (21, 30, 63, 90)
FALSE_RETURN, FALSE_DRAWDOWN = -0.05, -0.15

LAST = "QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY day DESC) = 1"


@query(f"WITH {BARS} SELECT ticker, day, idx, open, high, low, close, adj_close, volume FROM bars")
def scan_bars(spark, sf):
    return bars(spark, sf).select("ticker", "day", "idx", "open", "high", "low", "close", "adj_close", "volume")


@query(f"WITH {BARS}, r AS (SELECT ticker, day, round(price / lag(price, 30) OVER w - 1, 6) AS return_30, round(price / lag(price, 90) OVER w - 1, 6) AS return_90 FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY day)) SELECT * FROM r {LAST}")
def return_n_session(spark, sf):
    b = bars(spark, sf)
    return b.select("ticker", "day", "idx", "n", _r(P.n_return(30)).alias("return_30"), _r(P.n_return(90)).alias("return_90")).where("idx = n - 1").drop("idx", "n")


@query(f"WITH {BARS} SELECT ticker, day, round((price / lag(price) OVER (PARTITION BY ticker ORDER BY day) - 1) * 100, 6) AS change_pct FROM bars {LAST}")
def daily_change_pct(spark, sf):
    return bars(spark, sf).select("ticker", "day", "idx", "n", _r(P.n_return(1) * 100).alias("change_pct")).where("idx = n - 1").drop("idx", "n")


@query(f"WITH {BARS} SELECT ticker, day, round(ln(price / lag(price) OVER (PARTITION BY ticker ORDER BY day)), 6) AS log_return FROM bars")
def log_returns(spark, sf):
    return bars(spark, sf).select("ticker", "day", _r(P.log_return()).alias("log_return"))


LR = "lrs AS (SELECT *, ln(price / lag(price) OVER (PARTITION BY ticker ORDER BY day)) AS r FROM bars)"


@query(f"WITH {BARS}, {LR} SELECT ticker, round(CASE WHEN count(r) >= 30 THEN stddev_samp(r) * sqrt(252) END, 6) AS volatility FROM lrs WHERE idx >= n - 252 GROUP BY ticker")
def annualized_volatility(spark, sf):
    b = P.last_rows(bars(spark, sf).withColumn("r", P.log_return()), 252)
    return b.groupBy("ticker").agg(_r(F.when(F.count("r") >= 30, F.stddev_samp("r") * F.sqrt(F.lit(252.0)))).alias("volatility"))


@query(f"WITH {BARS}, {LR} SELECT ticker, day, round(CASE WHEN count(r) OVER w >= 10 THEN stddev_samp(r) OVER w * sqrt(252) END, 5) AS vol_21 FROM lrs WINDOW w AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)")
def rolling_volatility(spark, sf):
    return bars(spark, sf).withColumn("r", P.log_return()).select("ticker", "day", _r(P.rolling_volatility("r", 21, 10), 5).alias("vol_21"))


@query(f"WITH {BARS}, p AS (SELECT ticker, price, max(price) OVER (PARTITION BY ticker ORDER BY day) AS peak FROM bars WHERE idx >= n - 252) SELECT ticker, round(least(0, min(price / peak - 1)), 6) AS drawdown FROM p GROUP BY ticker")
def max_drawdown_252(spark, sf):
    return P.drawdown_last(bars(spark, sf), 252).select("ticker", _r("drawdown").alias("drawdown"))


@query(f"WITH {BARS}, p AS (SELECT s.ticker, s.day, b.price, max(b.price) OVER (PARTITION BY s.ticker, s.idx ORDER BY b.idx) AS peak FROM bars s JOIN bars b ON b.ticker = s.ticker AND b.idx BETWEEN s.idx - 63 AND s.idx) SELECT ticker, day, round(least(0, min(price / peak - 1)), 6) AS drawdown_63 FROM p GROUP BY ticker, day")
def rolling_drawdown_63(spark, sf):
    return bars(spark, sf).select("ticker", "day", _r(P.rolling_drawdown(63)).alias("drawdown_63"))


@query(f"WITH {BARS} SELECT ticker, day, round(CASE WHEN idx >= 42 THEN avg(volume) OVER (PARTITION BY ticker ORDER BY day ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) / avg(volume) OVER (PARTITION BY ticker ORDER BY day ROWS BETWEEN 41 PRECEDING AND 21 PRECEDING) - 1 END, 6) AS volume_trend FROM bars")
def volume_trend_21(spark, sf):
    return bars(spark, sf).select("ticker", "day", _r(P.volume_trend()).alias("volume_trend"))


@query(f"WITH {BARS}, p AS (SELECT ticker, idx - (n - 63) AS k, price FROM bars WHERE idx >= n - 63), w AS (SELECT a.ticker, b.price > a.price AS up FROM p a JOIN p b ON a.ticker = b.ticker AND b.k = a.k + 5 WHERE a.k % 5 = 0) SELECT ticker, round(avg(CAST(up AS DOUBLE)), 6) AS week_ratio FROM w GROUP BY ticker")
def positive_week_ratio(spark, sf):
    rows = P.last_rows(bars(spark, sf), 63).withColumn("k", F.col("idx") - (F.col("n") - 63)).withColumn("later", F.lead("price", 5).over(P.by_day()))
    rows = rows.where("k % 5 = 0 and later is not null")
    return rows.groupBy("ticker").agg(_r(F.avg((F.col("later") > F.col("price")).cast("double"))).alias("week_ratio"))


@query(f"WITH {BARS}, p AS (SELECT ticker, ln(price / lag(price) OVER (PARTITION BY ticker ORDER BY day)) AS r FROM bars WHERE idx >= n - 63) SELECT ticker, round(coalesce(stddev_samp(CASE WHEN r < 0 THEN r END), 0), 6) AS downside_vol FROM p GROUP BY ticker")
def downside_volatility(spark, sf):
    rows = P.last_rows(bars(spark, sf), 63).withColumn("r", P.log_return())
    return rows.groupBy("ticker").agg(_r(F.coalesce(F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))), F.lit(0.0))).alias("downside_vol"))


@query(f"WITH {BARS}, p AS (SELECT ticker, day, price, price / lag(price) OVER (PARTITION BY ticker ORDER BY day) - 1 AS r FROM bars WHERE idx >= n - 63) SELECT ticker, round(max(abs(r)) / sum(abs(r)), 6) AS largest_day, round(greatest(max(r), 0) / CASE WHEN arg_max(price, day) > arg_min(price, day) THEN arg_max(price, day) / arg_min(price, day) - 1 END, 6) AS gain_share FROM p GROUP BY ticker")
def spike_contribution(spark, sf):
    rows = P.last_rows(bars(spark, sf), 63).withColumn("r", P.n_return(1))
    first, last = F.min_by("price", "day"), F.max_by("price", "day")
    return rows.groupBy("ticker").agg(_r(F.try_divide(F.max(F.abs("r")), F.sum(F.abs("r")))).alias("largest_day"), _r(F.greatest(F.max("r"), F.lit(0.0)) / F.when(last > first, last / first - 1)).alias("gain_share"))


@query(f"WITH {BARS}, p AS (SELECT * FROM bars WHERE idx >= n - 130) SELECT ticker, min(price) AS low_130, max(price) AS high_130, round(max(price) - min(price), 6) AS span_130, min(day) AS first_day, max(day) AS last_day, count(*) AS sessions FROM p GROUP BY ticker")
def chart_last_130(spark, sf):
    return P.last_rows(bars(spark, sf), 130).groupBy("ticker").agg(F.min("price").alias("low_130"), F.max("price").alias("high_130"), _r(F.max("price") - F.min("price")).alias("span_130"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("sessions"))


@query(f"WITH {BARS} SELECT ticker, day, idx FROM bars WHERE idx >= 126 AND (idx - 126) % 21 = 0")
def systematic_sample(spark, sf):
    return P.snapshots(bars(spark, sf), 21, 126).where("is_snapshot").select("ticker", "day", "idx")


@query(f"WITH {BARS}, {BENCH} SELECT b.ticker, b.day, s.price AS bench_price FROM (SELECT ticker, day, day - 1 AS d FROM bars) b ASOF LEFT JOIN bench s ON b.d >= s.day")
def asof_backward_benchmark(spark, sf):
    left = bars(spark, sf).select("ticker", F.col("day").alias("own_day"), F.date_sub("day", 1).alias("day"))
    return P.asof_backward(left, benchmark_bars(spark, sf), out="bench_price").select("ticker", F.col("own_day").alias("day"), "bench_price")


@query(f"WITH {BARS} SELECT a.ticker, a.day, round(ln(b.price / a.price), 6) AS target_30 FROM (SELECT *, day + 30 AS due FROM bars) a ASOF LEFT JOIN bars b ON a.ticker = b.ticker AND a.due <= b.day")
def asof_forward_calendar(spark, sf):
    return bars(spark, sf).select("ticker", "day", _r(P.target_after(30)).alias("target_30"))


HORIZONS = (30, 60, 90)


def _events(spark, sf, horizons: tuple[int, ...] = ()) -> DataFrame:
    """(ticker, signal, signal_day, entry_day, entry_price, entry_idx): snapshots entered at the next session.

    With ``horizons`` also ``after``: the outcome of each horizon that the series reaches."""
    b = bars(spark, sf)
    rows = b.select("ticker", "day", "idx", "n", "price", P.n_return(30).alias("r30"), F.lead("day").over(P.by_day()).alias("entry_day"), F.lead("price").over(P.by_day()).alias("entry_price"), *([P.outcomes(horizons).alias("after")] if horizons else []))
    signal = F.when(F.col("r30") >= 0, "up").otherwise("down")
    rows = rows.where("idx >= 252 and (idx - 252) % 21 = 0 and entry_day is not null")
    return rows.select("ticker", signal.alias("signal"), F.col("day").alias("signal_day"), "entry_day", "entry_price", (F.col("idx") + 1).alias("entry_idx"), *(["after"] if horizons else []))


EVENTS = f"""WITH {BARS}, {BENCH}, e0 AS (SELECT ticker, day, idx, price / lag(price, 30) OVER w - 1 AS r30, lead(day) OVER w AS entry_day, lead(price) OVER w AS entry_price FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY day)),
events AS (SELECT ticker, CASE WHEN r30 >= 0 THEN 'up' ELSE 'down' END AS signal, day AS signal_day, entry_day, entry_price, idx + 1 AS entry_idx FROM e0 WHERE idx >= 252 AND (idx - 252) % 21 = 0 AND entry_day IS NOT NULL)"""


@query(EVENTS + " SELECT * FROM events")
def next_session_entry(spark, sf):
    return _events(spark, sf)


def _against_benchmark(events: DataFrame, bench: DataFrame) -> DataFrame:
    """One row for each outcome in ``after``, with forward, benchmark and excess return and the worst price on the way against the entry."""
    e = events.withColumn("o", F.explode("after")).select(*events.drop("after").columns, "o.*")
    s1, s2 = (bench.select(F.col("day").alias(d), F.col("price").alias(c)) for d, c in (("entry_day", "s1"), ("outcome_day", "s2")))
    e = e.join(s1, "entry_day", "left").join(s2, "outcome_day", "left").where("entry_price > 0")
    e = e.withColumn("fwd", F.col("outcome_price") / F.col("entry_price") - 1).withColumn("bench", F.when(F.col("s1") > 0, F.col("s2") / F.col("s1") - 1))
    return e.withColumn("excess", F.col("fwd") - F.col("bench")).withColumn("adverse", F.col("low") / F.col("entry_price") - 1)


def observations(spark, sf) -> DataFrame:
    """Outcomes after 30, 60 and 90 sessions against the benchmark on the same days."""
    e = _against_benchmark(_events(spark, sf, HORIZONS), benchmark_bars(spark, sf)).where("bench is not null")
    return e.select("ticker", "signal", "signal_day", "entry_day", "outcome_day", "horizon", _r("fwd").alias("forward_return"), _r("bench").alias("bench_return"), _r("excess").alias("excess_return"), _r("adverse").alias("adverse_drawdown"), F.when(F.col("bench") >= 0, "benchmark_up").otherwise("benchmark_down").alias("regime"))


OBS = EVENTS + """, obs AS (SELECT e.ticker, signal, signal_day, entry_day, o.day AS outcome_day, h.horizon,
 round(o.price / entry_price - 1, 6) AS forward_return, round(s2.price / s1.price - 1, 6) AS bench_return, round((o.price / entry_price - 1) - (s2.price / s1.price - 1), 6) AS excess_return,
 round((SELECT min(p.price) FROM bars p WHERE p.ticker = e.ticker AND p.idx BETWEEN e.entry_idx AND e.entry_idx + h.horizon) / entry_price - 1, 6) AS adverse_drawdown,
 CASE WHEN s2.price / s1.price - 1 >= 0 THEN 'benchmark_up' ELSE 'benchmark_down' END AS regime
 FROM events e CROSS JOIN (SELECT unnest([30, 60, 90])::INT AS horizon) h JOIN bars o ON o.ticker = e.ticker AND o.idx = e.entry_idx + h.horizon JOIN bench s1 ON s1.day = entry_day JOIN bench s2 ON s2.day = o.day)"""


@query(OBS + " SELECT * FROM obs")
def backtest_observations(spark, sf):
    return observations(spark, sf)


@query(OBS + " SELECT ticker, entry_day, horizon, outcome_day, forward_return FROM obs WHERE horizon = 30")
def offset_outcome(spark, sf):
    return observations(spark, sf).where("horizon = 30").select("ticker", "entry_day", "horizon", "outcome_day", "forward_return")


@query(f"WITH {BARS}, {BENCH} SELECT b.ticker, b.day, b.price, s.price AS bench_price FROM bars b JOIN bench s ON b.day = s.day")
def exact_benchmark_align(spark, sf):
    return bars(spark, sf).select("ticker", "day", "price").join(benchmark_bars(spark, sf).select("day", F.col("price").alias("bench_price")), "day")


@query(OBS + """ SELECT signal, horizon, coalesce(regime, 'all') AS regime, count(*) AS n, round(avg(forward_return), 5) AS mean_forward, round(avg(excess_return), 5) AS mean_excess,
 round(avg(excess_return) - coalesce(1.96 * stddev_samp(excess_return) / sqrt(count(*)), 0), 5) AS ci_low, round(avg(excess_return) + coalesce(1.96 * stddev_samp(excess_return) / sqrt(count(*)), 0), 5) AS ci_high,
 round(avg(CASE WHEN excess_return > 0 THEN 1.0::DOUBLE ELSE 0.0 END), 5) AS win_rate, round(avg(adverse_drawdown), 5) AS mean_drawdown FROM obs GROUP BY GROUPING SETS ((signal, horizon, regime), (signal, horizon))""")
def backtest_cohorts_grouping_sets(spark, sf):
    observations(spark, sf).createOrReplaceTempView("observations")
    return spark.sql("""SELECT signal, horizon, coalesce(regime, 'all') AS regime, count(*) AS n, round(avg(forward_return), 5) AS mean_forward, round(avg(excess_return), 5) AS mean_excess,
      round(avg(excess_return) - coalesce(1.96D * stddev_samp(excess_return) / sqrt(count(*)), 0D), 5) AS ci_low, round(avg(excess_return) + coalesce(1.96D * stddev_samp(excess_return) / sqrt(count(*)), 0D), 5) AS ci_high,
      round(avg(if(excess_return > 0, 1D, 0D)), 5) AS win_rate, round(avg(adverse_drawdown), 5) AS mean_drawdown
      FROM observations GROUP BY GROUPING SETS ((signal, horizon, regime), (signal, horizon))""")


@query(OBS + " SELECT ticker, horizon, count(*) AS overlaps FROM (SELECT ticker, horizon, entry_day, lag(outcome_day) OVER (PARTITION BY ticker, horizon ORDER BY entry_day) AS prior FROM obs) WHERE entry_day <= prior GROUP BY 1, 2")
def overlap_windows(spark, sf):
    prior = F.lag("outcome_day").over(Window.partitionBy("ticker", "horizon").orderBy("entry_day"))
    return observations(spark, sf).withColumn("prior", prior).where("entry_day <= prior").groupBy("ticker", "horizon").agg(F.count(F.lit(1)).alias("overlaps"))


@query("SELECT o_custkey AS entity, count(*) AS snapshots, count(*) FILTER (CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INT) > CAST(o_orderdate AS DATE) + 30) AS rejected FROM orders GROUP BY 1")
def leakage_rejects(spark, sf):
    from .domain import facts

    late = F.col("filed") > F.date_add("period_end", 30)
    return facts(spark, sf).groupBy("entity").agg(F.count(F.lit(1)).alias("snapshots"), F.count_if(late).alias("rejected"))


def _trend(spark, sf, history: bool) -> DataFrame:
    b = bars(spark, sf)
    if history:
        win = T.spaced_windows(b, 21, 126, ahead=max(AFTER) + 1)
    else:
        win = T.windows(b, b.where("idx = n - 1").select("ticker", F.col("idx").alias("e")))
    # the benchmark as of each bar's day, once; its returns are then lags within the series
    bench = benchmark_bars(spark, sf).select("day", F.struct("price", "idx").alias("v"))
    marked = P.asof_backward(b.select("ticker", "idx", "day"), bench, value="v", out="v").select("ticker", "idx", "day", F.col("v.price").alias("s"), (F.col("v.idx") + 1).alias("known"))
    ret = [F.when(F.lag("s", n).over(P.by_day()) > 0, F.col("s") / F.lag("s", n).over(P.by_day()) - 1).alias(f"bench{n}") for n in (21, 63)]
    marked = marked.select("ticker", F.col("idx").alias("e"), F.coalesce("known", F.lit(0)).alias("bench_known"), *ret)
    return T.scores(T.metrics(win.join(marked, ["ticker", "e"], "left")))


def _fit(name: str, low: str, high: str) -> str:
    return f"""{name}p AS MATERIALIZED (SELECT s.ticker, s.e, b.idx - min(b.idx) OVER (PARTITION BY s.ticker, s.e) AS k, ln(b.price) AS lp, b.price, b.idx FROM snap s JOIN bars b ON b.ticker = s.ticker AND b.idx BETWEEN {low} AND {high}),
{name}s AS MATERIALIZED (SELECT a.ticker, a.e, median((b.lp - a.lp) / (b.k - a.k)) AS slope FROM {name}p a JOIN {name}p b ON a.ticker = b.ticker AND a.e = b.e AND a.k < b.k GROUP BY ALL),
{name}c AS MATERIALIZED (SELECT p.ticker, p.e, s.slope, median(p.lp - s.slope * p.k) AS cut FROM {name}p p JOIN {name}s s USING (ticker, e) GROUP BY ALL),
{name}f AS (SELECT p.ticker, p.e, any_value(c.slope) AS slope, greatest(0, least(1, 1 - sum((lp - (cut + slope * k)) ** 2) / (var_pop(lp) * count(*)))) AS r2, stddev_samp(lp - (cut + slope * k)) AS residual_vol, avg(CASE WHEN lp - (cut + slope * k) >= -1e-9 THEN 1.0::DOUBLE ELSE 0 END) AS above FROM {name}p p JOIN {name}c c USING (ticker, e) GROUP BY p.ticker, p.e)"""


def _clip(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE greatest(0, least(100, {x})) END)"


def _wm(parts: list[tuple[str, float]]) -> str:
    num = " + ".join(f"coalesce({x} * {w}::DOUBLE, 0)" for x, w in parts)
    den = " + ".join(f"(CASE WHEN {x} IS NULL THEN 0::DOUBLE ELSE {w}::DOUBLE END)" for x, w in parts)
    return f"(({num}) / ({den}))"


def _ramp(x: str, lo: float, hi: float) -> str:
    return _clip(f"({x} - ({lo}::DOUBLE)) / ({hi}::DOUBLE - ({lo}::DOUBLE)) * 100")


def _part(x: str, target: float) -> str:
    return _clip(f"{x} / {target}::DOUBLE * 100")


def trend_sql(history: bool) -> str:
    snap = f"SELECT ticker, idx AS e, day FROM bars WHERE idx >= 126 AND (idx - 126) % 21 = 0 AND idx < n - {max(AFTER) + 1}" if history else "SELECT ticker, idx AS e, day FROM bars WHERE idx = n - 1"
    return f"""WITH {BARS}, {BENCH}, snap AS MATERIALIZED ({snap}), {_fit('ta', 's.e - 62', 's.e')}, {_fit('tc', 's.e - 20', 's.e')}, {_fit('td', 's.e - 62', 's.e - 21')},
ret AS (SELECT s.ticker, s.e, s.day, b0.price / b21.price - 1 AS r21, b0.price / b63.price - 1 AS r63, b21.day AS d21, b63.day AS d63 FROM snap s JOIN bars b0 ON b0.ticker = s.ticker AND b0.idx = s.e JOIN bars b21 ON b21.ticker = s.ticker AND b21.idx = s.e - 21 JOIN bars b63 ON b63.ticker = s.ticker AND b63.idx = s.e - 63),
be AS (SELECT r.ticker, r.e, x.price AS b1 FROM ret r ASOF LEFT JOIN bench x ON r.day >= x.day), b21 AS (SELECT r.ticker, r.e, x.price AS b21 FROM ret r ASOF LEFT JOIN bench x ON r.d21 >= x.day), b63 AS (SELECT r.ticker, r.e, x.price AS b63 FROM ret r ASOF LEFT JOIN bench x ON r.d63 >= x.day),
pr AS (SELECT ticker, e, k, price, lag(price) OVER w AS prev, max(price) OVER w AS peak, lead(price, 5) OVER w AS later FROM tap WINDOW w AS (PARTITION BY ticker, e ORDER BY k)),
pm AS (SELECT ticker, e, least(0, min(price / peak - 1)) AS dd, coalesce(stddev_samp(CASE WHEN price < prev THEN ln(price / prev) END), 0) AS dv, max(abs(price / prev - 1)) / sum(abs(price / prev - 1)) AS ld, avg(CASE WHEN later > price THEN 1.0::DOUBLE ELSE 0 END) FILTER (k % 5 = 0 AND later IS NOT NULL) AS wr,
 greatest(max(price / prev - 1), 0) / CASE WHEN arg_max(price, k) > arg_min(price, k) THEN arg_max(price, k) / arg_min(price, k) - 1 END AS gs FROM pr GROUP BY ticker, e),
m AS (SELECT ret.ticker, ret.e, ret.day, coalesce(ld >= 0.35, false) OR coalesce(gs >= 0.65, false) AS spiky, round(r21, 8) AS return21, round(r63, 8) AS return63, round(tcf.slope, 8) AS slope21, round(taf.slope, 8) AS slope63, round(exp(taf.slope * 252) - 1, 8) AS annualized63, round(taf.r2, 8) AS r2_63, round(wr, 8) AS week_ratio, round(taf.residual_vol, 8) AS residual_vol, round(dd, 8) AS max_drawdown, round(dv, 8) AS downside_vol,
 round(r21 - (b1 / b21 - 1), 8) AS excess21, round(r63 - (b1 / b63 - 1), 8) AS excess63, round(tcf.slope - tdf.slope, 8) AS acceleration, round(ld, 8) AS largest_day, round(taf.above, 8) AS above
 FROM ret JOIN be USING (ticker, e) JOIN b21 USING (ticker, e) JOIN b63 USING (ticker, e) JOIN pm USING (ticker, e) JOIN taf USING (ticker, e) JOIN tcf USING (ticker, e) JOIN tdf USING (ticker, e)),
sub AS (SELECT *, round({_wm([(_part('annualized63', 0.35), 0.45), (_part('return63', 0.12), 0.35), (_part('return21', 0.03), 0.20)])}, 4) AS direction,
 round({_wm([(_ramp('r2_63', 0.25, 0.75), 0.35), (_ramp('week_ratio', 0.45, 0.80), 0.30), (_ramp('above', 0.45, 0.75), 0.15), (_clip('100 * (1 - residual_vol / 0.055::DOUBLE)'), 0.20)])}, 4) AS consistency,
 round({_wm([(_ramp('excess63', -0.08, 0.08), 0.65), (_ramp('excess21', -0.04, 0.04), 0.35)])}, 4) AS relative, round({_clip('100 * (1 - abs(max_drawdown) / 0.30::DOUBLE)')}, 4) AS drawdown_control,
 round({_wm([(_part('return21', 0.03), 0.40), (_part('slope21', 0.001), 0.40), (_ramp('acceleration', -0.001, 0.001), 0.20)])}, 4) AS confirmation FROM m),
tot AS (SELECT *, CASE WHEN spiky THEN least(t, 54) ELSE t END AS total FROM (SELECT *, round({_wm([('direction', 0.30), ('consistency', 0.25), ('relative', 0.20), ('drawdown_control', 0.15), ('confirmation', 0.10)])}, 4) AS t FROM sub)),
trend AS MATERIALIZED (SELECT *, round(total, 2) AS score, CASE WHEN total >= 70 AND slope63 > 0 AND return63 > 0 AND NOT spiky AND return21 >= 0 AND r2_63 >= 0.45 AND week_ratio >= 0.60 AND max_drawdown >= -0.15 THEN 'detected' WHEN total >= 55 AND slope63 > 0 AND return63 > 0 AND NOT spiky THEN 'emerging' ELSE 'not_detected' END AS status FROM tot)"""


@query(trend_sql(False) + " SELECT ticker, day, round(slope63, 6) AS slope63, round(r2_63, 6) AS r2_63, round(residual_vol, 6) AS residual_vol, round(above, 6) AS above FROM trend")
def theil_sen_63(spark, sf):
    return _trend(spark, sf, False).select("ticker", "day", *[_r(c).alias(c) for c in ("slope63", "r2_63", "residual_vol", "above")])


_PARTS = ("direction", "consistency", "relative", "drawdown_control", "confirmation")


@query(trend_sql(False) + f" SELECT ticker, day, status, round(score, 1) AS score, spiky, {', '.join(f'round({c}, 2) AS {c}' for c in _PARTS)} FROM trend")
def trend_scores(spark, sf):
    return _trend(spark, sf, False).select("ticker", "day", "status", _r("score", 1).alias("score"), "spiky", *[_r(c, 2).alias(c) for c in _PARTS])


@query(trend_sql(False) + " SELECT status, count(*) AS n FROM trend GROUP BY status")
def trend_status_counts(spark, sf):
    return _trend(spark, sf, False).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(trend_sql(False) + ", x AS (SELECT ticker, round(total, 1) AS v FROM trend) SELECT ticker, v AS score, round((rank() OVER (ORDER BY v) - 1 + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE) / (count(*) OVER () - 1), 6) AS pct FROM x")
def trend_percentiles(spark, sf):
    return average_rank(written(_trend(spark, sf, False).select("ticker", _r("total", 1).alias("score")), "trend-totals"), "score", [], "pct")


def _history(spark, sf, digits: int = 6) -> DataFrame:
    """Detected snapshots, entered at the next session, with their outcomes after 21, 30, 63 and 90 sessions."""
    d = _trend(spark, sf, True).where("status = 'detected'").select("ticker", "e", F.col("day").alias("signal_day"), "score")
    path = bars(spark, sf).select("ticker", F.col("idx").alias("e"), F.lead("day").over(P.by_day()).alias("entry_day"), F.lead("price").over(P.by_day()).alias("entry_price"), P.outcomes(AFTER).alias("after"))
    o = _against_benchmark(d.join(path, ["ticker", "e"]), benchmark_bars(spark, sf))
    o = o.join(securities(spark, sf).select("ticker", "sector"), "ticker", "left")
    return o.select("ticker", F.coalesce("sector", F.lit("unknown")).alias("sector"), F.year("signal_day").cast("string").alias("year"), "signal_day", "entry_day", F.col("outcome_day").alias("exit_day"), "horizon", _r("score", 1).alias("score"), _r("fwd", digits).alias("forward_return"), _r("bench", digits).alias("bench_return"), _r("excess", digits).alias("excess_return"), _r("adverse", digits).alias("drawdown"),
                    F.when(F.col("bench") > 0, "positive").otherwise("non_positive").alias("regime"), (F.coalesce(F.col("fwd") <= FALSE_RETURN, F.lit(False)) | F.coalesce(F.col("adverse") <= FALSE_DRAWDOWN, F.lit(False))).alias("false_positive"))


def _history_sql(digits: int = 6) -> str:
    return trend_sql(True) + f""", det AS (SELECT ticker, e, day, score, h.horizon FROM trend CROSS JOIN (SELECT unnest({list(AFTER)})::INT AS horizon) h WHERE status = 'detected'), {SECURITIES},
hist AS (SELECT d.*, p.day AS entry_day, o.day AS exit_day, o.price / p.price - 1 AS f, s2.price / s1.price - 1 AS s, (SELECT min(x.price) FROM bars x WHERE x.ticker = d.ticker AND x.idx BETWEEN d.e + 1 AND d.e + 1 + d.horizon) / p.price - 1 AS dd
 FROM det d JOIN bars p ON p.ticker = d.ticker AND p.idx = d.e + 1 JOIN bars o ON o.ticker = d.ticker AND o.idx = d.e + 1 + d.horizon LEFT JOIN bench s1 ON s1.day = p.day LEFT JOIN bench s2 ON s2.day = o.day),
history AS (SELECT h.ticker, coalesce(sector, 'unknown') AS sector, year(day)::VARCHAR AS year, day AS signal_day, entry_day, exit_day, horizon, round(score, 1) AS score, round(f, {digits}) AS forward_return, round(s, {digits}) AS bench_return, round(f - s, {digits}) AS excess_return, round(dd, {digits}) AS drawdown,
 CASE WHEN s > 0 THEN 'positive' ELSE 'non_positive' END AS regime, coalesce(f <= {FALSE_RETURN}, false) OR coalesce(dd <= {FALSE_DRAWDOWN}, false) AS false_positive FROM hist h LEFT JOIN securities USING (ticker))"""


@query(_history_sql() + " SELECT * FROM history")
def trend_history(spark, sf):
    return _history(spark, sf)


def _summary(true: str, share: str) -> str:
    """Outcomes of all observations, and by horizon, market, sector and year."""
    one = f"CASE WHEN {{}} THEN {true} ELSE {share} END"
    return f"""SELECT CASE WHEN grouping(horizon) = 0 THEN 'horizon' WHEN grouping(regime) = 0 THEN 'regime' WHEN grouping(sector) = 0 THEN 'sector' ELSE 'year' END AS grouped_by,
 coalesce(CAST(horizon AS VARCHAR(20)), regime, sector, year) AS value, count(*) AS n, round(avg({one.format('forward_return > 0')}), 5) AS positive, round(median(forward_return), 5) AS median_return, round(avg(forward_return), 5) AS mean_return,
 round(median(excess_return), 5) AS median_excess, round(avg(excess_return), 5) AS mean_excess, round(median(drawdown), 5) AS median_drawdown, round(avg(drawdown), 5) AS mean_drawdown,
 round(avg({one.format('false_positive')}), 5) AS false_positive_rate, CAST(sum(CASE WHEN false_positive THEN 1 ELSE 0 END) AS BIGINT) AS false_positives FROM history GROUP BY GROUPING SETS ((horizon), (regime), (sector), (year))"""


@query(_history_sql(12) + " " + _summary("1.0::DOUBLE", "0.0::DOUBLE"))
def trend_history_groups(spark, sf):
    return spark.sql("WITH history AS (SELECT * FROM {rows}) " + _summary("1D", "0D"), rows=_history(spark, sf, 12))


@query(trend_sql(True) + " SELECT status, count(*) AS n, count(DISTINCT ticker) AS tickers FROM trend GROUP BY status")
def trend_history_sample(spark, sf):
    """How many snapshots were judged, by status."""
    return _trend(spark, sf, True).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ticker").alias("tickers"))
