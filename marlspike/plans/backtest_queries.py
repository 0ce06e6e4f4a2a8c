"""Queries of the point-in-time backtest: features and signals as known on each date, their outcomes, rejections and cohorts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspike.operators import backtest as B
from marlspike.operators import brief as A
from marlspike.operators import scoring as S
from marlspike.sources.scratch import written
from marlspike.sources.tables import table

from .domain import BARS, FACTS, SECURITIES, bars, exchange_bars, facts, securities
from .fact_queries import FEATURES, LABELS, SCORED
from .registry import query

#: The exchange whose lines make the benchmark; it doesn't trade on every day on which a series does.
EXCHANGE = "ASIA"
_CONCEPTS = ["assets", "liabilities", "revenue", "income", "shares"]


def _facts(spark, sf) -> DataFrame:
    """Facts of the concepts that the features need: a label names one, and a preliminary revenue is the gross profit."""
    named = F.create_map(*[F.lit(x) for pair in zip(LABELS, _CONCEPTS) for x in pair])
    gross = (F.col("label") == LABELS[2]) & (F.col("form") == "P")
    return facts(spark, sf).select(F.col("entity").alias("ticker"), F.when(gross, "gross_profit").otherwise(named[F.col("label")]).alias("concept"), (gross | F.col("form").isin("F", "O")).alias("annual"), "value", "period_end", "filed", "accession")


def _prices(spark, sf) -> tuple[DataFrame, DataFrame, object]:
    """The series, their prices as known on the signal dates, and the last day of any bar."""
    until = table(spark, sf, "lineitem").agg(F.max(F.col("l_shipdate").cast("date"))).first()[0]
    lines = written(B.series(bars(spark, sf)), "series")
    return lines, B.prices_known(lines, until), until


def _raw(spark, sf) -> DataFrame:
    _, prices, until = _prices(spark, sf)
    return B.features_of(prices, B.facts_known(_facts(spark, sf), until))


def _evaluated(spark, sf, *known: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Snapshots, their outcomes and the series; with names of ``known`` dates for each of these, told apart by ``known_by``."""
    lines, prices, until = _prices(spark, sf)
    prices = written(prices, "prices") if len(known) > 1 else prices
    found = [B.snapshots(B.features_of(prices, B.facts_known(_facts(spark, sf), until, k))).withColumn("known_by", F.lit(k)) for k in known or ("filed",)]
    found = written(reduce(DataFrame.unionByName, found), "snapshots")
    bench = written(exchange_bars(spark, sf, EXCHANGE), "exchange")
    return found, written(B.evaluate(found, lines, bench, by=("known_by",)), "evaluated"), lines


_CASES = " ".join(f"WHEN '{x}' THEN '{n}'" for x, n in zip(LABELS, _CONCEPTS))


def _raw_sql(known: str = "filed") -> str:
    two = ", ".join(f"max(value) FILTER (concept = '{c}' AND k = {k}) AS {n}_{c}" for c in B.ANNUAL for k, n in ((1, "last"), (2, "prior")))
    latest = ", ".join(f"arg_max(value, (period_end, filed, accession)) FILTER (concept = '{c}') AS {c}" for c in B.LATEST)
    pos = lambda c: f"(CASE WHEN {c} > 0 THEN {c} END)"
    cap = f"(price * {pos('shares')})"
    made = {
        "earnings_yield": f"last_income / {cap}", "sales_yield": f"{pos('last_revenue')} / {cap}", "liabilities_to_assets": f"liabilities / {pos('assets')}", "revenue_growth": f"{pos('last_revenue')} / {pos('prior_revenue')} - 1",
        "net_margin": f"last_income / {pos('last_revenue')}", "net_margin_trend": f"last_income / {pos('last_revenue')} - prior_income / {pos('prior_revenue')}",
        "gross_margin": f"last_gross_profit / {pos('last_revenue')}", "latest_revenue": pos("last_revenue"), "gross_profit": "last_gross_profit",
    }
    return f"""{BARS}, {SECURITIES}, {FACTS}, concepts AS (SELECT *, CASE WHEN label = '{LABELS[2]}' AND form = 'P' THEN 'gross_profit' ELSE CASE label {_CASES} END END AS concept FROM facts),
cal AS (SELECT CAST(unnest(generate_series(DATE '1970-01-01', DATE '2099-10-01', INTERVAL 3 MONTH)) AS DATE) AS signal_date),
rt AS (SELECT ticker, day, idx, price, price / lag(price, 30) OVER w - 1 AS return_30d, price / lag(price, 90) OVER w - 1 AS return_90d, ln(price / lag(price) OVER w) AS lr, lead(day) OVER w AS next_day FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY day)),
vt AS (SELECT *, CASE WHEN count(lr) OVER v >= 30 THEN stddev_samp(lr) OVER v * sqrt(252) END AS annualized_volatility FROM rt WINDOW v AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
ps AS MATERIALIZED (SELECT vt.*, signal_date FROM vt JOIN cal ON signal_date >= day AND signal_date < coalesce(next_day, (SELECT max(day) + 1 FROM bars))),
dd AS (SELECT ticker, signal_date, least(0, min(price / peak - 1)) AS max_drawdown_1y FROM (SELECT p.ticker, p.signal_date, b.price, max(b.price) OVER (PARTITION BY p.ticker, p.signal_date ORDER BY b.day) AS peak FROM ps p JOIN bars b ON b.ticker = p.ticker AND b.idx BETWEEN p.idx - 251 AND p.idx) GROUP BY 1, 2),
kf AS MATERIALIZED (SELECT p.ticker, p.signal_date, f.concept, f.form, f.value, f.period_end, f.filed, f.accession FROM ps p JOIN concepts f ON f.entity = p.ticker AND f.{known} <= p.signal_date),
fl AS (SELECT ticker, signal_date, max(filed) AS max_filed, {latest} FROM kf GROUP BY 1, 2),
fy AS (SELECT ticker, signal_date, concept, year(period_end) AS y, arg_max(value, (filed, accession)) AS value FROM kf WHERE form IN ('F', 'O') OR concept = 'gross_profit' GROUP BY 1, 2, 3, 4),
fa AS (SELECT ticker, signal_date, {two} FROM (SELECT *, row_number() OVER (PARTITION BY ticker, signal_date, concept ORDER BY y DESC) AS k FROM fy) GROUP BY 1, 2),
feat AS MATERIALIZED (SELECT ticker, signal_date, day AS price_through, max_filed, {', '.join(f'round({made.get(f, f)}, 6) AS {f}' for f in B.RAW)} FROM ps LEFT JOIN dd USING (ticker, signal_date) LEFT JOIN fl USING (ticker, signal_date) LEFT JOIN fa USING (ticker, signal_date))"""


def _scored_sql(known: str = "filed") -> str:
    """The scoring of one cross-section, by signal date."""
    dated = SCORED[len("WITH " + FEATURES):].replace("PARTITION BY feature", "PARTITION BY signal_date, feature").replace("SELECT ticker", "SELECT ticker, signal_date").replace("GROUP BY ticker", "GROUP BY ticker, signal_date")
    risk = "round(greatest(0, least(100, 100 - momentum)), 4)"  # greatest skips a null in SQL
    dated = dated.replace(risk, f"CASE WHEN momentum IS NOT NULL THEN {risk} END")
    return _raw_sql(known) + dated


def _evaluated_sql(known: str = "filed") -> str:
    return f"""WITH {_scored_sql(known)}, snaps AS (SELECT s.ticker, s.signal_date, s.signal, coalesce(f.price_through > s.signal_date, false) OR coalesce(f.max_filed > s.signal_date, false) AS leaks FROM scored s JOIN feat f ON f.ticker = s.ticker AND f.signal_date = s.signal_date),
elr AS (SELECT CAST(l_shipdate AS DATE) AS day, CAST(round(0.5 * (CAST(sum(CAST(l_discount AS DECIMAL(18,6))) AS DOUBLE) / count(*) - 0.05), 8) AS DECIMAL(18,8)) AS lr FROM lineitem JOIN securities ON ticker = l_suppkey WHERE exchange = '{EXCHANGE}' GROUP BY 1),
ebench AS MATERIALIZED (SELECT day, round(100 * exp(CAST(sum(lr) OVER (ORDER BY day) AS DOUBLE)), 6) AS price FROM elr),
entries AS MATERIALIZED (SELECT s.*, (SELECT min(idx) FROM bars b WHERE b.ticker = s.ticker AND b.day > s.signal_date) AS entry_idx FROM snaps s),
ev0 AS (SELECT e.ticker, e.signal_date, e.signal, e.leaks, h.horizon, i.day AS entry_day, i.price AS entry_price, o.day AS outcome_day, o.price AS outcome_price, e.entry_idx, x.price AS bench_in, y.price AS bench_out
 FROM entries e LEFT JOIN (SELECT unnest([30, 60, 90])::INT AS horizon) h ON NOT e.leaks AND e.entry_idx IS NOT NULL LEFT JOIN bars i ON NOT e.leaks AND i.ticker = e.ticker AND i.idx = e.entry_idx LEFT JOIN bars o ON NOT e.leaks AND o.ticker = e.ticker AND o.idx = e.entry_idx + h.horizon LEFT JOIN ebench x ON x.day = i.day LEFT JOIN ebench y ON y.day = o.day),
ev1 AS (SELECT *, CASE WHEN leaks THEN 'leakage' WHEN entry_day IS NULL THEN 'no_entry' WHEN outcome_day IS NULL THEN 'open' WHEN bench_in IS NULL OR bench_out IS NULL THEN 'unaligned' ELSE 'observed' END AS status FROM ev0),
evaluated AS MATERIALIZED (SELECT ticker, signal_date, signal, status, horizon, entry_day, outcome_day, CASE WHEN status = 'observed' THEN round(outcome_price / entry_price - 1, 6) END AS forward_return, CASE WHEN status = 'observed' THEN round(bench_out / bench_in - 1, 6) END AS bench_return,
 CASE WHEN status = 'observed' THEN round((outcome_price / entry_price - 1) - (bench_out / bench_in - 1), 6) END AS excess_return, CASE WHEN status = 'observed' THEN round((SELECT min(p.price) FROM bars p WHERE p.ticker = ev1.ticker AND p.idx BETWEEN ev1.entry_idx AND ev1.entry_idx + ev1.horizon) / entry_price - 1, 6) END AS adverse_drawdown,
 CASE WHEN status = 'observed' THEN CASE WHEN bench_out / bench_in - 1 >= 0 THEN 'benchmark_up' ELSE 'benchmark_down' END END AS regime FROM ev1)"""


@query(f"WITH {_raw_sql()} SELECT * FROM feat")
def point_in_time_features(spark, sf):
    """The thirteen raw features of every series on every signal date, from prices and filings known by then."""
    return _raw(spark, sf)


_SCORES = [*S.WEIGHTS, "momentum_risk"]
#: Scores have four digits; this much more keeps one digit of them off the ties.
_OFF = 0.00003


@query(f"WITH {_scored_sql()} SELECT ticker, signal_date, price_through, max_filed, available, confidence, signal, {', '.join(f'round(scored.{c} + {_OFF}, 1) AS {c}' for c in _SCORES)} FROM scored JOIN (SELECT ticker, signal_date, price_through, max_filed FROM feat) USING (ticker, signal_date)")
def point_in_time_signals(spark, sf):
    """Scores and signal of every series among all of its signal date."""
    found = B.snapshots(_raw(spark, sf))
    return found.select("ticker", "signal_date", "price_through", "max_filed", F.col("available").cast("bigint").alias("available"), "confidence", "signal", *[F.round(F.col(c) + _OFF, 1).alias(c) for c in _SCORES])


@query(_evaluated_sql() + " SELECT * FROM evaluated")
def evaluated_snapshots(spark, sf):
    """Outcomes after 30, 60 and 90 sessions of every snapshot, or why there is none."""
    return _evaluated(spark, sf)[1].drop("known_by")


_AUDIT = """ SELECT '{0}' AS known_by, (SELECT count(*) FROM snaps) AS snapshots, count(*) FILTER (status = 'observed') AS observations, count(*) FILTER (status = 'leakage') AS rejected_leakage, count(*) FILTER (status IN ('no_entry', 'unaligned')) AS rejected_alignment,
 (SELECT count(*) FROM (SELECT entry_day, lag(outcome_day) OVER (PARTITION BY ticker, horizon ORDER BY entry_day, signal_date) AS prior FROM evaluated WHERE status = 'observed') WHERE entry_day <= prior) AS overlapping,
 (SELECT count(*) FROM securities WHERE ticker NOT IN (SELECT ticker FROM bars)) AS missing_symbols FROM evaluated"""


@query("SELECT *, rejected_leakage = 0 AND missing_symbols = 0 AND observations > 0 AS passed, CASE WHEN observations > 0 THEN 'complete' ELSE 'insufficient_data' END AS status FROM (" + " UNION ALL ".join(f"(SELECT * FROM ({_evaluated_sql(k)}{_AUDIT.format(k)}))" for k in ("filed", "period_end")) + ")")
def backtest_bias_audit(spark, sf):
    """The audit of snapshots by filing date, which passes, and by period end, which uses filings before they were made."""
    modes = ("filed", "period_end")
    found, evaluated, lines = _evaluated(spark, sf, *modes)
    of = lambda rows, k: rows.where(F.col("known_by") == k)
    out = [B.bias_audit(of(evaluated, k), of(found, k), lines, securities(spark, sf)).select(F.lit(k).alias("known_by"), "*") for k in modes]
    return out[0].unionByName(out[1])


def _mean_sql(c: str) -> str:
    """Mean of a six-digit column, rounded half up to six digits over whole numbers."""
    total = f"sum(CAST(round({c} * 1000000) AS BIGINT))"
    return f"CAST(sign({total}) * ((2 * abs({total}) + count(*)) // (2 * count(*))) AS DOUBLE) / 1000000"


@query(_evaluated_sql() + f""" SELECT signal, horizon, coalesce(regime, 'all') AS regime, count(*) AS n, {_mean_sql('forward_return')} AS mean_forward, {_mean_sql('bench_return')} AS mean_bench, {_mean_sql('excess_return')} AS mean_excess,
 round(avg(excess_return) - coalesce(1.96 * stddev_samp(excess_return) / sqrt(count(*)), 0), 6) AS ci_low, round(avg(excess_return) + coalesce(1.96 * stddev_samp(excess_return) / sqrt(count(*)), 0), 6) AS ci_high,
 round(avg(CASE WHEN excess_return > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS win_rate, {_mean_sql('adverse_drawdown')} AS mean_drawdown FROM evaluated WHERE status = 'observed' GROUP BY GROUPING SETS ((signal, horizon, regime), (signal, horizon))""")
def signal_cohorts(spark, sf):
    """What followed each signal, in all and by the benchmark's direction."""
    return B.cohorts(_evaluated(spark, sf)[1])


def _brief_sql() -> str:
    """Markdown of the last signal date's briefs, put together in SQL."""
    case = lambda i: "CASE signal " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in A.TEMPLATES.items()) + " END"
    valid = lambda c: f"coalesce({c} BETWEEN 0 AND 100, false)"
    facts_ = ["'- The current rules classify ' || ticker || ' as ' || words || ' with ' || lower(confidence) || ' confidence. [Source: signals:' || ticker || ']'"]
    facts_ += [f"CASE WHEN {valid(c)} THEN '- {n}: ' || printf('%.1f', round({c}, 1)) || ' out of 100. [Source: signals:' || ticker || ':scores.{c}]' END" for c, n in A.LABELS.items()]
    facts_.append("CASE WHEN n IS NOT NULL THEN '- The 90-session ' || words || ' cohort contains ' || n || ' observations, with mean excess return ' || CASE WHEN mean_excess >= 0 THEN '+' ELSE '' END || printf('%.1f', round(mean_excess * 100, 1)) || '% and win rate ' || printf('%.1f', round(win_rate * 100, 1)) || '%. This descriptive result is not a forecast. [Source: backtest:' || signal || ':90]' END")
    gaps = [f"CASE WHEN NOT {valid(c)} THEN '- {n} score is unavailable.' END" for c, n in A.LABELS.items()] + [f"CASE WHEN n IS NULL THEN '- {A.NO_COHORT}' END", f"'- {A.NO_EVIDENCE}'"]
    asks = ["'- Which operating or industry conditions could invalidate the current ' || words || ' classification?'", *[f"'- {q}'" for q in A.QUESTIONS], f"CASE WHEN NOT ({valid('market_risk')} AND {valid('balance_risk')}) THEN '- {A.MORE}' END"]
    lines = [f"'# ' || ticker || ': ' || {case(0)}", "''", case(1), "''", "'## Validated facts'", *facts_, "''", "'## Retrieved filing evidence'", "'- No cited filing passages are available.'", "''", "'## Missing sections'", *gaps, "''", "'## Research next'", *asks, "''", f"'{A.DISCLAIMER}'"]
    return f"SELECT ticker, signal AS template_id, array_to_string(list_filter([{', '.join(lines)}], lambda x: x IS NOT NULL), chr(10)) AS markdown FROM board"


@query(_evaluated_sql() + f""", coh AS (SELECT signal, count(*) AS n, {_mean_sql('excess_return')} AS mean_excess, round(avg(CASE WHEN excess_return > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS win_rate FROM evaluated WHERE status = 'observed' AND horizon = 90 GROUP BY signal),
board AS (SELECT s.*, replace(s.signal, '-', ' ') AS words, n, mean_excess, win_rate FROM scored s LEFT JOIN coh ON coh.signal = s.signal WHERE signal_date = (SELECT max(signal_date) FROM scored)) """ + _brief_sql())
def analyst_briefs(spark, sf):
    """Markdown of a brief for every series of the last signal date, with the cohort of its signal."""
    found, evaluated, _ = _evaluated(spark, sf)
    cohorts = B.cohorts(evaluated).where("horizon = 90 and regime = 'all'")
    last = found.agg(F.max("signal_date").alias("signal_date"))  # one row
    rows = found.join(F.broadcast(last), "signal_date", "left_semi")
    return A.briefs(rows, cohorts).select("ticker", "template_id", A.markdown().alias("markdown"))
