"""Queries over facts and cross-sections: latest and annual facts, features, scores, the balance model, joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlspike.functions.exprs import artifact_stem, money, normalize_cik, normalize_ticker
from marlspike.operators import prices as P
from marlspike.operators import scoring as S
from marlspike.operators.universe import classify
from marlspike.sources import sinks
from marlspike.sources.scratch import written
from marlspike.sources.tables import table

from .domain import BARS, BENCH, FACTS, SECURITIES, bars, benchmark_bars, facts, securities
from .registry import query


def _r(c, d=6):
    return F.round(c, d)


LABELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_NAMES = ["assets", "liabilities", "revenue", "income", "shares"]


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events")
def json_props_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), "event_type")


@query("SELECT l_orderkey, t.pos, t.partkey, t.qty FROM (SELECT l_orderkey, unnest(list_zip(range(1, len(p) + 1), p, q)) AS z FROM (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity) AS p, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) AS q FROM lineitem GROUP BY 1)) x, LATERAL (SELECT CAST(z[1] AS INT) AS pos, z[2] AS partkey, z[3] AS qty) t")
def zip_parallel_arrays(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("a"))
    g = g.select("l_orderkey", F.col("a.l_partkey").alias("partkey"), F.col("a.l_quantity").alias("qty"))
    z = g.select("l_orderkey", F.posexplode(F.arrays_zip("partkey", "qty")).alias("pos", "z"))
    return z.select("l_orderkey", (F.col("pos") + 1).alias("pos"), "z.partkey", "z.qty")


@query("SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, replace(upper(trim(c_name)), '.', '-') AS ticker, lpad(CAST(c_custkey AS VARCHAR), 10, '0') || ':' || replace(upper(trim(c_name)), '.', '-') AS key FROM customer")
def normalize_symbols(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", normalize_cik("c_custkey").alias("cik"), normalize_ticker("c_name").alias("ticker"), F.concat_ws(":", normalize_cik("c_custkey"), normalize_ticker("c_name")).alias("key"))


_PARTS = "SELECT p_partkey, upper(substr(p_name, 1, 5)) || CASE p_size % 5 WHEN 0 THEN '-W' WHEN 1 THEN 'U' ELSE '' END AS ticker, p_name || CASE p_size % 7 WHEN 0 THEN ' Trust' ELSE '' END AS name, CASE p_size % 3 WHEN 0 THEN 'NYSE' WHEN 1 THEN 'OTC' END AS exchange FROM part"


@query(f"""SELECT p_partkey, ticker, CASE WHEN exclude_reason IS NULL THEN 100 WHEN exclude_reason = 'exchange' THEN 700 ELSE 900 END AS priority, exclude_reason FROM (SELECT *, CASE WHEN length(ticker) >= 5 AND regexp_matches(ticker, '[RUW]$') THEN 'suffix' WHEN regexp_matches(upper(name), '\\b(?:ACQUISITION|CAPITAL|SPONSOR|BLANK CHECK)\\b') AND regexp_matches(ticker, '[RUW]$') THEN 'spac'
 WHEN regexp_matches(ticker, '-(?:W|WS|WTS?|R|RT|U|UN|UT|UNIT|P[A-Z]?|PR[A-Z]?)$') THEN 'class' WHEN regexp_matches(upper(name), '\\b(?:ETF|ETN|FUND|TRUST|SPAC|RIGHTS?|UNIT|PREFERRED)\\b|\\bWARRANT') THEN 'fund' WHEN upper(coalesce(exchange, 'NYSE')) NOT IN ('NYSE', 'NASDAQ', 'NYSE AMERICAN') THEN 'exchange' END AS exclude_reason FROM ({_PARTS}))""")
def classify_universe(spark, sf):
    p = table(spark, sf, "part")
    ticker = F.concat(F.upper(F.substring("p_name", 1, 5)), F.when(F.col("p_size") % 5 == 0, "-W").when(F.col("p_size") % 5 == 1, "U").otherwise(""))
    rows = p.select("p_partkey", ticker.alias("ticker"), F.concat("p_name", F.when(F.col("p_size") % 7 == 0, " Trust").otherwise("")).alias("name"), F.when(F.col("p_size") % 3 == 0, "NYSE").when(F.col("p_size") % 3 == 1, "OTC").alias("exchange"))
    return classify(rows).select("p_partkey", "ticker", "priority", "exclude_reason")


@query("SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) > 1 AS duplicate FROM customer")
def universe_dedupe(spark, sf):
    n = F.row_number().over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", "c_mktsegment", (n > 1).alias("duplicate"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 ORDER BY c_mktsegment, c_custkey LIMIT 50 OFFSET 100")
def universe_limit_offset(spark, sf):
    return table(spark, sf, "customer").where("c_acctbal > 0").orderBy("c_mktsegment", "c_custkey").offset(100).limit(50).select("c_custkey", "c_name")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '_CON' ELSE replace(c_mktsegment, ' ', '-') END AS stem FROM customer")
def artifact_stems(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", artifact_stem(F.when(F.col("c_custkey") % 4 == 0, "con").otherwise(F.col("c_mktsegment"))).alias("stem"))


def latest(f: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the fact with the greatest (period_end, filed, accession)."""
    return f.groupBy(*keys).agg(F.max_by(F.struct("value", "form", "period_end", "filed", "accession"), F.struct("period_end", "filed", "accession")).alias("x")).select(*keys, "x.*")


@query(f"WITH {FACTS} SELECT entity, label, value, period_end, filed FROM facts QUALIFY row_number() OVER (PARTITION BY entity, label ORDER BY period_end DESC, filed DESC, accession DESC) = 1")
def latest_fact_per_label(spark, sf):
    return latest(facts(spark, sf), ["entity", "label"]).select("entity", "label", "value", "period_end", "filed")


@query(f"WITH {FACTS}, y AS (SELECT entity, year(period_end) AS y, value FROM facts WHERE form IN ('F', 'O') QUALIFY row_number() OVER (PARTITION BY entity, year(period_end) ORDER BY filed DESC, accession DESC) = 1), n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY y DESC) AS k FROM y) SELECT entity, max(value) FILTER (k = 1) AS last_value, max(value) FILTER (k = 2) AS prior_value FROM n WHERE k <= 2 GROUP BY entity")
def annual_series_last_two(spark, sf):
    return _annual(facts(spark, sf))


def _annual(f: DataFrame) -> DataFrame:
    """Last two annual values: the last filed of each year, then the two latest years."""
    y = f.where(F.col("form").isin("F", "O")).groupBy("entity", F.year("period_end").alias("y")).agg(F.max_by("value", F.struct("filed", "accession")).alias("value"))
    k = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("y")))
    return y.withColumn("k", k).where("k <= 2").groupBy("entity").agg(F.max(F.when(F.col("k") == 1, F.col("value"))).alias("last_value"), F.max(F.when(F.col("k") == 2, F.col("value"))).alias("prior_value"))


@query(f"WITH {FACTS}, ref AS (SELECT entity, accession AS ra, period_end AS rp FROM facts QUALIFY row_number() OVER (PARTITION BY entity ORDER BY period_end DESC, filed DESC, form = 'F' DESC, accession DESC) = 1) SELECT entity, label, value, CASE WHEN accession = ra AND period_end = rp THEN 2 WHEN period_end = rp THEN 1 ELSE 0 END AS level FROM facts JOIN ref USING (entity) QUALIFY row_number() OVER (PARTITION BY entity, label ORDER BY level DESC, period_end DESC, filed DESC, accession DESC) = 1")
def fact_context_ladder(spark, sf):
    f = facts(spark, sf)
    ref = f.groupBy("entity").agg(F.max_by(F.struct("accession", "period_end"), F.struct("period_end", "filed", F.col("form") == "F", "accession")).alias("r"))
    m = f.join(ref, "entity").withColumn("level", F.when((F.col("accession") == F.col("r.accession")) & (F.col("period_end") == F.col("r.period_end")), 2).when(F.col("period_end") == F.col("r.period_end"), 1).otherwise(0))
    return m.groupBy("entity", "label").agg(F.max_by(F.struct("value", "level"), F.struct("level", "period_end", "filed", "accession")).alias("x")).select("entity", "label", "x.value", "x.level")


def pivoted(f: DataFrame) -> DataFrame:
    p = f.groupBy("entity").pivot("label", LABELS).agg(F.max_by("value", F.struct("period_end", "filed", "accession")))
    return p.select("entity", *[F.col(f"`{x}`").alias(n) for x, n in zip(LABELS, _NAMES)])


PIVOT = FACTS + ", latest AS (SELECT entity, label, arg_max(value, (period_end, filed, accession)) AS value FROM facts GROUP BY 1, 2), pivoted AS (SELECT entity, " + ", ".join(f"max(value) FILTER (label = '{x}') AS {n}" for x, n in zip(LABELS, _NAMES)) + " FROM latest GROUP BY entity)"


@query(f"WITH {PIVOT} SELECT * FROM pivoted")
def balance_pivot(spark, sf):
    return pivoted(facts(spark, sf))


def _fundamentals(f: DataFrame) -> DataFrame:
    """(ticker, the pivoted labels, last_value, prior_value) in one pass over the facts: by year, then by entity."""
    latest_of = lambda test: F.max(F.when(test, F.struct("period_end", "filed", "accession", "value")))
    year = f.groupBy("entity", F.year("period_end").alias("y")).agg(F.max(F.when(F.col("form").isin("F", "O"), F.struct("filed", "accession", "value"))).alias("annual"), *[latest_of(F.col("label") == x).alias(n) for x, n in zip(LABELS, _NAMES)])
    years = F.sort_array(F.collect_list(F.when(F.col("annual").isNotNull(), F.struct("y", F.col("annual.value").alias("value")))), asc=False)
    g = year.groupBy(F.col("entity").alias("ticker")).agg(years.alias("years"), *[F.max(n).alias(n) for n in _NAMES])
    return g.select("ticker", *[F.col(f"{n}.value").alias(n) for n in _NAMES], F.get("years", F.lit(0))["value"].alias("last_value"), F.get("years", F.lit(1))["value"].alias("prior_value"))


def _features(spark, sf) -> DataFrame:
    """One row per series with the ten features: prices from its bars, fundamentals from the entity of its number."""
    # one pass over the bars, one row a ticker; the window and the groups share their partitioning
    peak = F.max(F.when(F.col("idx") >= F.col("n") - 252, F.col("price"))).over(P.by_day().rowsBetween(Window.unboundedPreceding, 0))
    b = bars(spark, sf).withColumns({"return_30d": P.n_return(30), "return_90d": P.n_return(90), "lr": P.log_return(), "peak": peak}).withColumn("late", F.col("idx") >= F.col("n") - 252)
    lr = F.when(F.col("late"), F.col("lr"))
    x = b.groupBy("ticker").agg(F.max_by(F.struct(F.col("day").alias("as_of"), "return_30d", "return_90d", "price"), "idx").alias("last"),
                                F.when(F.count(lr) >= 30, F.stddev_samp(lr) * F.sqrt(F.lit(252.0))).alias("annualized_volatility"),
                                F.least(F.lit(0.0), F.min(F.when(F.col("late"), F.col("price") / F.col("peak") - 1))).alias("max_drawdown_1y"))
    x = x.select("ticker", "last.*", "annualized_volatility", "max_drawdown_1y").join(_fundamentals(facts(spark, sf)), "ticker", "left")
    cap = F.when(F.col("shares") > 0, F.col("price") * F.col("shares"))
    pos = lambda c: F.when(F.col(c) > 0, F.col(c))
    raw = {"earnings_yield": F.col("income") / cap, "sales_yield": pos("revenue") / cap, "liabilities_to_assets": F.col("liabilities") / pos("assets"), "revenue_growth": pos("last_value") / pos("prior_value") - 1,
           "net_margin": F.col("income") / pos("revenue"), "net_margin_trend": F.col("income") / pos("revenue") - F.col("income") / pos("last_value")}
    x = x.withColumns(raw)
    return x.select("ticker", "as_of", *[F.round(F.col(n), 6).alias(n) for n in S.BOUNDS])


FEATURES = f"""{BARS}, {PIVOT}, fy AS (SELECT entity, year(period_end) AS y, arg_max(value, (filed, accession)) AS value FROM facts WHERE form IN ('F', 'O') GROUP BY 1, 2), fk AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY y DESC) AS k FROM fy),
an AS (SELECT entity, max(value) FILTER (k = 1) AS last_value, max(value) FILTER (k = 2) AS prior_value FROM fk WHERE k <= 2 GROUP BY entity),
rt AS (SELECT *, price / lag(price, 30) OVER w - 1 AS return_30d, price / lag(price, 90) OVER w - 1 AS return_90d, ln(price / lag(price) OVER w) AS lr FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY day)),
vo AS (SELECT ticker, CASE WHEN count(lr) >= 30 THEN stddev_samp(lr) * sqrt(252) END AS annualized_volatility FROM rt WHERE idx >= n - 252 GROUP BY ticker),
pk AS (SELECT ticker, price, max(price) OVER (PARTITION BY ticker ORDER BY day) AS peak FROM bars WHERE idx >= n - 252), dd AS (SELECT ticker, least(0, min(price / peak - 1)) AS max_drawdown_1y FROM pk GROUP BY ticker),
feat AS MATERIALIZED (SELECT rt.ticker, rt.day AS as_of, round(return_30d, 6) AS return_30d, round(return_90d, 6) AS return_90d, round(annualized_volatility, 6) AS annualized_volatility, round(max_drawdown_1y, 6) AS max_drawdown_1y,
 round(income / CASE WHEN shares > 0 THEN price * shares END, 6) AS earnings_yield, round(CASE WHEN revenue > 0 THEN revenue END / CASE WHEN shares > 0 THEN price * shares END, 6) AS sales_yield, round(liabilities / CASE WHEN assets > 0 THEN assets END, 6) AS liabilities_to_assets,
 round(CASE WHEN last_value > 0 THEN last_value END / CASE WHEN prior_value > 0 THEN prior_value END - 1, 6) AS revenue_growth, round(income / CASE WHEN revenue > 0 THEN revenue END, 6) AS net_margin, round(income / CASE WHEN revenue > 0 THEN revenue END - income / CASE WHEN last_value > 0 THEN last_value END, 6) AS net_margin_trend
 FROM rt JOIN vo USING (ticker) JOIN dd USING (ticker) LEFT JOIN pivoted p ON p.entity = rt.ticker LEFT JOIN an ON an.entity = rt.ticker WHERE idx = n - 1)"""


@query(f"WITH {FEATURES} SELECT * FROM feat")
def feature_table(spark, sf):
    return _features(spark, sf)


@query(f"WITH {FEATURES} SELECT ticker, " + ", ".join(f"CASE WHEN {f} IS NULL THEN NULL ELSE round(greatest({b[2]}::DOUBLE, least({b[3]}::DOUBLE, {f})), 6) END AS {f}" for f, b in S.BOUNDS.items()) + ", array_to_string(list_filter([" + ", ".join(f"CASE WHEN {f} NOT BETWEEN {b[0]} AND {b[1]} THEN '{f}' END" for f, b in S.BOUNDS.items()) + "], lambda x: x IS NOT NULL), ',') AS warnings FROM feat")
def winsorize_range_flags(spark, sf):
    return _features(spark, sf).select("ticker", *[_r(S.winsorized(f)).alias(f) for f in S.BOUNDS], F.array_join(S.range_warnings(), ",").alias("warnings"))


@query(f"WITH {FEATURES} SELECT ticker, " + ", ".join(f"{f} IS NULL AS {f}" for f in S.BOUNDS) + " FROM feat")
def missing_flags(spark, sf):
    return _features(spark, sf).select("ticker", *[F.col(f).isNull().alias(f) for f in S.BOUNDS])


def _pct(f: str) -> str:
    lo, hi = S.BOUNDS[f][2:]
    return f"SELECT ticker, '{f}' AS feature, {f} AS value, CASE WHEN {f} IS NULL THEN NULL ELSE greatest({lo}::DOUBLE, least({hi}::DOUBLE, {f})) END AS winsor FROM feat"


PCT = f"""WITH {FEATURES}, long AS ({' UNION ALL '.join(_pct(f) for f in S.BOUNDS)}),
pct AS MATERIALIZED (SELECT ticker, feature, value, CASE WHEN winsor IS NULL THEN NULL WHEN count(winsor) OVER (PARTITION BY feature) = 1 THEN 0.5::DOUBLE ELSE round((rank() OVER (PARTITION BY feature, winsor IS NULL ORDER BY winsor) - 1 + (count(*) OVER (PARTITION BY feature, winsor) - 1) / 2.0::DOUBLE) / (count(winsor) OVER (PARTITION BY feature) - 1), 6) END AS pct FROM long)"""


@query(PCT + " SELECT ticker, feature, pct FROM pct")
def avg_rank_percentile(spark, sf):
    return S.percentiles(written(_features(spark, sf), "features")).select("ticker", "feature", "pct")


def _component(name: str) -> str:
    parts = [(f"(1 - p_{f})" if f in S.INVERTED else f"p_{f}", w) for f, w in S.WEIGHTS[name].items()]
    num = " + ".join(f"coalesce({x} * {w}::DOUBLE, 0)" for x, w in parts)
    den = " + ".join(f"CASE WHEN {x} IS NULL THEN 0::DOUBLE ELSE {w}::DOUBLE END" for x, w in parts)
    return f"CASE WHEN ({den}) > 0 THEN round(greatest(0, least(100, ({num}) / ({den}) * 100)), 4) END AS {name}"


SCORED = PCT + f""", wide AS (SELECT ticker, {', '.join(f"max(pct) FILTER (feature = '{f}') AS p_{f}" for f in S.BOUNDS)}, count(value) AS available FROM pct GROUP BY ticker),
comp AS (SELECT ticker, available, {', '.join(_component(c) for c in S.WEIGHTS)}, {', '.join('p_' + f for f in S.BOUNDS)} FROM wide),
conf AS (SELECT *, round(greatest(0, least(100, 100 - momentum)), 4) AS momentum_risk, CASE WHEN available >= 9 THEN 'High' WHEN available >= 7 THEN 'Medium' WHEN available >= 5 THEN 'Low' ELSE 'Insufficient' END AS confidence FROM comp),
scored AS MATERIALIZED (SELECT *, CASE WHEN confidence = 'Insufficient' THEN 'insufficient-evidence' WHEN value >= 65 AND balance_risk >= 70 THEN 'value-trap-risk' WHEN momentum_risk >= 70 THEN 'momentum-risk'
 WHEN value >= 70 AND quality >= 50 AND coalesce(market_risk, 0) < 70 AND coalesce(balance_risk, 0) < 70 THEN 'potentially-undervalued' WHEN quality >= 70 AND coalesce(balance_risk, 0) < 70 THEN 'quality-watchlist' ELSE 'neutral' END AS signal FROM conf)"""
_SCORES = list(S.WEIGHTS) + ["momentum_risk"]


def _scored(spark, sf) -> DataFrame:
    return S.score(S.wide_percentiles(written(_features(spark, sf), "features")))


@query(SCORED + f" SELECT ticker, {', '.join(f'round({c}, 3) AS {c}' for c in _SCORES)} FROM scored")
def component_scores(spark, sf):
    return _scored(spark, sf).select("ticker", *[_r(c, 3).alias(c) for c in _SCORES])


@query(SCORED + " SELECT ticker, available, confidence, signal FROM scored")
def classify_signal(spark, sf):
    return _scored(spark, sf).select("ticker", F.col("available").cast("bigint").alias("available"), "confidence", "signal")


@query(SCORED + """ SELECT ticker, array_to_string(list_filter([CASE confidence WHEN 'Insufficient' THEN 'EVIDENCE_SPARSE' WHEN 'High' THEN 'EVIDENCE_COMPLETE' ELSE 'EVIDENCE_PARTIAL' END, CASE WHEN value >= 70 THEN 'VALUE_STRONG' WHEN value <= 30 THEN 'VALUE_WEAK' END, CASE WHEN quality >= 70 THEN 'QUALITY_STRONG' WHEN quality <= 30 THEN 'QUALITY_WEAK' END,
 CASE WHEN momentum_risk >= 70 THEN 'MOMENTUM_RISK_HIGH' END, CASE WHEN market_risk >= 70 THEN 'MARKET_RISK_HIGH' END, CASE WHEN balance_risk >= 70 THEN 'BALANCE_SHEET_RISK_HIGH' END], lambda x: x IS NOT NULL), ',') AS codes FROM scored""")
def reason_codes(spark, sf):
    return _scored(spark, sf).select("ticker", F.array_join(S.reason_codes(), ",").alias("codes"))


def _directed(f: str) -> str:
    return f"(1 - p_{f})" if f in S.INVERTED else f"p_{f}"


def _contribution(name: str, f: str) -> str:
    w = S.WEIGHTS[name]
    total = " + ".join(f"CASE WHEN p_{x} IS NULL THEN 0::DOUBLE ELSE {y}::DOUBLE END" for x, y in w.items())
    return f"SELECT ticker, '{name}' AS component, '{f}' AS feature, round({w[f]}::DOUBLE / ({total}), 6) AS weight, round({_directed(f)} * {w[f]}::DOUBLE / ({total}) * 100, 4) AS points FROM scored WHERE p_{f} IS NOT NULL"


CONTRIBUTIONS = SCORED + ", contributions AS (" + " UNION ALL ".join(_contribution(c, f) for c, w in S.WEIGHTS.items() for f in w) + ")"


@query(CONTRIBUTIONS + " SELECT ticker, component, feature, round(weight, 5) AS weight, round(points, 3) AS points FROM contributions")
def contributions_exploded(spark, sf):
    return _scored(spark, sf).select("ticker", F.inline(S.contributions())).select("ticker", "component", "feature", _r("weight", 5).alias("weight"), _r("points", 3).alias("points"))


def _scenario_label(name: str, f: str, m: float) -> str:
    varied = {k: dict(v) for k, v in S.WEIGHTS.items()}
    varied[name][f] *= m
    parts = [(_directed(x), w) for x, w in varied[name].items()]
    num = " + ".join(f"coalesce({x} * {w!r}::DOUBLE, 0)" for x, w in parts)
    den = " + ".join(f"CASE WHEN {x} IS NULL THEN 0::DOUBLE ELSE {w!r}::DOUBLE END" for x, w in parts)
    one = f"CASE WHEN ({den}) > 0 THEN round(greatest(0, least(100, ({num}) / ({den}) * 100)), 4) END"
    new = f"momentum_risk AS o_momentum_risk, {one} AS {name}" if name != "momentum" else f"round(greatest(0, least(100, 100 - ({one}))), 4) AS momentum_risk"
    kept = [c for c in ("value", "quality", "market_risk", "balance_risk", "momentum_risk") if f"AS {c}" not in new]
    return f"""SELECT '{name}' AS component, '{f}' AS feature, {m}::DOUBLE AS multiplier, CAST(sum(CASE WHEN signal <> CASE WHEN confidence = 'Insufficient' THEN 'insufficient-evidence' WHEN value >= 65 AND balance_risk >= 70 THEN 'value-trap-risk' WHEN momentum_risk >= 70 THEN 'momentum-risk'
 WHEN value >= 70 AND quality >= 50 AND coalesce(market_risk, 0) < 70 AND coalesce(balance_risk, 0) < 70 THEN 'potentially-undervalued' WHEN quality >= 70 AND coalesce(balance_risk, 0) < 70 THEN 'quality-watchlist' ELSE 'neutral' END THEN 1 ELSE 0 END) AS BIGINT) AS changed
 FROM (SELECT signal, confidence, {', '.join(kept)}, {new} FROM scored)"""


@query(SCORED + " " + " UNION ALL ".join(_scenario_label(c, f, m) for c, w in S.WEIGHTS.items() for f in w for m in (0.8, 1.2)))
def sensitivity_scenarios(spark, sf):
    return S.sensitivity(S.wide_percentiles(written(_features(spark, sf), "features")))


@query(SCORED + """ SELECT ticker, list_aggregate(list_filter([CASE confidence WHEN 'Insufficient' THEN 'Fewer than five inputs are available.' WHEN 'High' THEN 'Nine inputs or more are available.' ELSE 'Some inputs are missing.' END, CASE WHEN value >= 70 THEN 'Value ranks in the top part of the universe.' WHEN value <= 30 THEN 'Value ranks in the bottom part of the universe.' END,
 CASE WHEN quality >= 70 THEN 'Quality ranks in the top part of the universe.' WHEN quality <= 30 THEN 'Quality ranks in the bottom part of the universe.' END, CASE WHEN momentum_risk >= 70 THEN 'Recent prices are weak against the universe.' END, CASE WHEN market_risk >= 70 THEN 'Drawdown and volatility are high.' END, CASE WHEN balance_risk >= 70 THEN 'Liabilities are high against assets.' END], lambda x: x IS NOT NULL), 'string_agg', ' | ') AS texts FROM scored""")
def signal_explanations(spark, sf):
    return _scored(spark, sf).select("ticker", F.array_join(S.explanations(S.reason_codes()), " | ").alias("texts"))


@query(SCORED + " SELECT ticker, signal, confidence, round(momentum, 3) AS momentum, round(market_risk, 3) AS market_risk FROM scored ORDER BY momentum DESC, ticker LIMIT 20")
def feature_screen(spark, sf):
    """Momentum and risk of every series against the others, the best twenty."""
    s = _scored(spark, sf).orderBy(F.desc("momentum"), "ticker").limit(20)
    return s.select("ticker", "signal", "confidence", _r("momentum", 3).alias("momentum"), _r("market_risk", 3).alias("market_risk"))


_BAL = {"assets": "4.0 * p + 5", "current_assets": "1.2 * p", "cash": "0.3 * p * (k % 4)", "investments": "CASE WHEN k % 3 = 0 THEN 0.1 * p END", "receivables": "CASE WHEN k % 5 <> 0 THEN 0.2 * p END", "goodwill": "CASE WHEN k % 2 = 0 THEN 0.5 * p * (k % 6) END", "intangibles": "CASE WHEN k % 7 = 0 THEN 0.3 * p END",
        "liabilities": "CASE WHEN k % 11 <> 0 THEN 2.0 * p END", "current_liabilities": "0.4 * p * (1 + k % 4)", "short_debt": "CASE WHEN k % 3 <> 1 THEN 0.2 * p * (k % 5) END", "long_debt": "0.5 * p * (k % 7)", "equity": "p * (k % 9 - 1)", "retained_earnings": "p * (k % 3 - 1)",
        "shares": "10.0 * (k % 8)", "market_cap": "CASE WHEN k % 6 <> 0 THEN 25.0 * p END"}


def _balance(spark, sf) -> DataFrame:
    """A balance sheet per part, made from its price and key."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("ticker"), F.col("p_retailprice").alias("p"), F.col("p_partkey").alias("k"))
    return S.ratios(p.select("ticker", *[F.round(F.expr(e).cast("double"), 4).alias(n) for n, e in _BAL.items()]))


_div = lambda n, d: f"round({n} / CASE WHEN {d} > 0 THEN {d} END, 6)"
BAL = f"""WITH p0 AS (SELECT p_partkey AS ticker, p_retailprice AS p, p_partkey AS k FROM part), bal AS (SELECT ticker, {', '.join(f'round(CAST({e} AS DOUBLE), 4) AS {n}' for n, e in _BAL.items())} FROM p0),
debt AS (SELECT *, CASE WHEN short_debt IS NOT NULL OR long_debt IS NOT NULL THEN round(coalesce(short_debt, 0) + coalesce(long_debt, 0), 6) END AS total_debt FROM bal),
ratio AS MATERIALIZED (SELECT *, {_div('current_assets', 'current_liabilities')} AS current_ratio, {_div('(cash + coalesce(investments, 0) + coalesce(receivables, 0))', 'current_liabilities')} AS quick_ratio, {_div('cash', 'current_liabilities')} AS cash_ratio, round(current_assets - current_liabilities, 6) AS working_capital,
 {_div('total_debt', 'equity')} AS debt_to_equity, {_div('total_debt', 'assets')} AS debt_to_assets, {_div('equity', 'assets')} AS equity_ratio, {_div('cash', 'total_debt')} AS cash_to_debt, round(total_debt - cash, 6) AS net_debt, {_div('(coalesce(goodwill, 0) + coalesce(intangibles, 0))', 'assets')} AS goodwill_share, {_div('short_debt', 'total_debt')} AS short_debt_share, equity AS book_value, {_div('equity', 'shares')} AS book_value_per_share, {_div('market_cap', 'equity')} AS price_to_book FROM debt)"""
_RATIOS = ["current_ratio", "quick_ratio", "cash_ratio", "working_capital", "debt_to_equity", "debt_to_assets", "equity_ratio", "cash_to_debt", "net_debt", "goodwill_share", "short_debt_share", "book_value", "book_value_per_share", "price_to_book", "retained_earnings"]


@query(BAL + f" SELECT ticker, {', '.join(f'round({c}, 6) AS {c}' for c in _RATIOS)} FROM ratio")
def balance_ratios(spark, sf):
    return _balance(spark, sf).select("ticker", *[_r(c).alias(c) for c in _RATIOS])


def _band_sql(m: str) -> str:
    if m in S.BANDS:
        way, a, b, c = S.BANDS[m]
        o1, o2 = (">=", ">=") if way == "up" else ("<", "<=")
        return f"CASE WHEN {m} IS NULL THEN 'unavailable' WHEN {m} {o1} {a} THEN 'healthy' WHEN {m} {o2} {b} THEN 'acceptable' WHEN {m} {o2} {c} THEN 'risk' ELSE 'severe_risk' END"
    if m == "working_capital":
        return f"CASE WHEN {m} IS NULL THEN 'unavailable' WHEN {m} >= 0 THEN 'healthy' WHEN current_ratio < 0.75 AND quick_ratio < 0.5 THEN 'severe_risk' ELSE 'risk' END"
    if m == "net_debt":
        return f"CASE WHEN {m} IS NULL THEN 'unavailable' WHEN {m} <= 0 THEN 'healthy' WHEN debt_to_assets > 0.6 AND current_ratio < 1.0 THEN 'risk' ELSE 'acceptable' END"
    return f"CASE WHEN {m} IS NULL THEN 'unavailable' WHEN {m} >= 0 THEN 'healthy' ELSE 'risk' END"


_BANDED = list(dict.fromkeys(m for w in S.SUB.values() for m in w))
GATES = {"g_liquidity": "current_ratio < 1.0 OR quick_ratio < 0.75 OR cash_ratio < 0.10 OR working_capital < 0", "g_severe_liquidity": "current_ratio < 0.75 AND quick_ratio < 0.50", "g_high_leverage": "debt_to_equity > 2.0 OR debt_to_assets > 0.60", "g_severe_leverage": "debt_to_equity > 3.0 OR debt_to_assets > 0.70", "g_negative_equity": "equity <= 0", "g_debt_maturity": "short_debt_share > 0.40 AND cash_to_debt < 0.20", "g_asset_quality_warning": "goodwill_share > 0.50", "g_incomplete": "assets IS NULL OR liabilities IS NULL OR equity IS NULL OR current_assets IS NULL OR current_liabilities IS NULL"}


@query(BAL + f" SELECT ticker, {', '.join(f'{_band_sql(m)} AS b_{m}' for m in _BANDED)} FROM ratio")
def balance_bands(spark, sf):
    return _balance(spark, sf).select("ticker", *[S.band(m).alias(f"b_{m}") for m in _BANDED])


@query(BAL + f" SELECT ticker, {', '.join(f'coalesce({c}, false) AS {g}' for g, c in GATES.items())} FROM ratio")
def balance_gates(spark, sf):
    return _balance(spark, sf).select("ticker", *[c.alias(f"g_{g}") for g, c in S.gates().items()])


def _pts(x: str) -> str:
    return f"CASE {x} WHEN 'healthy' THEN 90.0::DOUBLE WHEN 'acceptable' THEN 70 WHEN 'caution' THEN 55 WHEN 'risk' THEN 35 WHEN 'severe_risk' THEN 10 END"


def _sub_sql(w: dict, pre: str) -> str:
    num = " + ".join(f"coalesce(({_pts(pre + m)}) * {x}::DOUBLE, 0)" for m, x in w.items())
    den = " + ".join(f"CASE WHEN ({_pts(pre + m)}) IS NULL THEN 0::DOUBLE ELSE {x}::DOUBLE END" for m, x in w.items())
    return f"CASE WHEN ({den}) > 0 THEN round(({num}) / ({den}), 6) END"


def _capped(c: str, g: str, x: int) -> str:
    return f"CASE WHEN {g} THEN least(CASE WHEN coalesce({c}, 0) = 0 THEN {x} ELSE {c} END, {x}) ELSE {c} END AS {c}"


def _st(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'unavailable' WHEN {c} >= 80 THEN 'healthy' WHEN {c} >= 60 THEN 'acceptable' WHEN {c} >= 40 THEN 'caution' WHEN {c} >= 20 THEN 'risk' ELSE 'severe_risk' END"


BALANCE = BAL + f""", banded AS (SELECT *, {', '.join(f'{_band_sql(m)} AS b_{m}' for m in _BANDED)}, {', '.join(f'coalesce({c}, false) AS {g}' for g, c in GATES.items())} FROM ratio),
subs AS (SELECT *, {', '.join(f'{_sub_sql(w, "b_")} AS s_{n}' for n, w in S.SUB.items())} FROM banded),
cap1 AS (SELECT * REPLACE ({_capped('s_leverage', 'g_negative_equity', 15)}, {_capped('s_solvency', 'g_negative_equity', 15)}, {_capped('s_liquidity', 'g_severe_liquidity', 20)}) FROM subs), cap2 AS (SELECT * REPLACE ({_capped('s_leverage', 'g_severe_leverage', 20)}) FROM cap1),
st AS (SELECT *, {', '.join(f'{_st("s_" + n)} AS t_{n}' for n in S.QUALITY)} FROM cap2), q0 AS (SELECT *, {_sub_sql(S.QUALITY, 't_')} AS balance_quality, {' + '.join(f'({c} IS NULL)::INT' for c in S.FIELDS)} AS missing, g_negative_equity::INT + g_severe_liquidity::INT + g_severe_leverage::INT AS severe FROM st),
q AS (SELECT *, round(least(100, 100 - balance_quality + {' + '.join(f'CASE WHEN g_{g} THEN {p} ELSE 0 END' for g, p in S.PENALTY.items())}), 6) AS balance_penalty,
 CASE WHEN missing = {len(S.FIELDS)} THEN -15 ELSE greatest(-20, least(5, CASE WHEN missing > 0 THEN 0 ELSE 5 END - CASE WHEN assets IS NULL OR liabilities IS NULL OR equity IS NULL THEN 10 ELSE 0 END - CASE WHEN current_assets IS NULL OR current_liabilities IS NULL THEN 5 WHEN missing > 0 THEN 3 ELSE 0 END - CASE WHEN g_incomplete THEN 5 ELSE 0 END)) END AS confidence_adjustment FROM q0)"""


@query(BALANCE + f"""
SELECT ticker, {', '.join(f'round(s_{n}, 4)::DOUBLE AS s_{n}' for n in S.SUB)}, round(balance_quality, 4) AS balance_quality, round(balance_penalty, 4) AS balance_penalty, confidence_adjustment FROM q""")
def balance_quality(spark, sf):
    return S.balance_scores(_balance(spark, sf)).select("ticker", *[_r(f"s_{n}", 4).alias(f"s_{n}") for n in S.SUB], _r("balance_quality", 4).alias("balance_quality"), _r("balance_penalty", 4).alias("balance_penalty"), "confidence_adjustment")


@query(BALANCE + " SELECT ticker, array_to_string(list_filter([" + ", ".join(f"CASE WHEN g_{g} THEN '{g}:{v}' END" for g, v in S.SEVERITY.items()) + "], lambda x: x IS NOT NULL), ',') AS gates FROM q")
def gate_severities(spark, sf):
    rows = S.balance_scores(_balance(spark, sf))
    return rows.select("ticker", F.array_join(F.transform(S.triggered(), lambda g: F.concat_ws(":", g["name"], g["severity"])), ",").alias("gates"))


@query(BALANCE + " SELECT state, field, count(*) AS n FROM (SELECT CASE WHEN missing = " + str(len(S.FIELDS)) + " THEN 'unavailable' WHEN missing = 0 THEN 'available' ELSE 'partial' END AS state, unnest(list_concat(['all'], list_filter([" + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in S.FIELDS) + "], lambda x: x IS NOT NULL))) AS field FROM q) GROUP BY ALL")
def balance_manifest(spark, sf):
    """How many snapshots are available, partial or unavailable, and which fields are missing there."""
    fields = F.array_compact(F.array(F.lit("all"), *[F.when(F.col(c).isNull(), F.lit(c)) for c in S.FIELDS]))
    return S.balance_scores(_balance(spark, sf)).select(S.snapshot_state().alias("state"), F.explode(fields).alias("field")).groupBy("state", "field").agg(F.count(F.lit(1)).alias("n"))


def _with_balance(spark, sf) -> DataFrame:
    b = S.balance_scores(_balance(spark, sf)).select("ticker", "balance_quality", "balance_penalty", "confidence_adjustment", *[f"g_{g}" for g in S.gates()])
    return _scored(spark, sf).join(b, "ticker")


_CLASS = """CASE WHEN {c} = 'Insufficient' THEN 'insufficient-evidence' WHEN value >= 65 AND {b} >= 70 THEN 'value-trap-risk' WHEN momentum_risk >= 70 THEN 'momentum-risk' WHEN value >= 70 AND {q} >= 50 AND coalesce(market_risk, 0) < 70 AND coalesce({b}, 0) < 70 THEN 'potentially-undervalued' WHEN {q} >= 70 AND coalesce({b}, 0) < 70 THEN 'quality-watchlist' ELSE 'neutral' END"""
_LEVEL = "list_position(['Insufficient', 'Low', 'Medium', 'High'], {0})"
_MOVED = "['Insufficient', 'Low', 'Medium', 'High'][greatest(1, least(4, {0}))]"
OFFICIAL = SCORED + ", " + BALANCE[5:] + f""", both0 AS (SELECT s.*, balance_quality, balance_penalty, confidence_adjustment, severe, g_liquidity, g_severe_liquidity, g_high_leverage, g_severe_leverage, g_negative_equity, g_debt_maturity,
 coalesce(value >= 65, false) AND (severe > 0 OR coalesce(balance_penalty >= 70, false)) AS trap, severe > 0 OR coalesce(balance_quality < 60, false) AS weak FROM scored s JOIN q USING (ticker)),
exper AS (SELECT *, CASE WHEN trap THEN 'value-trap-risk' WHEN signal IN ('potentially-undervalued', 'quality-watchlist') AND weak THEN 'neutral' ELSE signal END AS experimental_signal,
 CASE WHEN trap THEN '{S.TRAP}' WHEN signal = 'potentially-undervalued' AND weak THEN '{S.VALUE_WEAK}' WHEN signal = 'quality-watchlist' AND weak THEN '{S.QUALITY_WEAK}' WHEN quality >= 70 AND balance_quality >= 60 AND signal = 'neutral' THEN '{S.SUPPORT}' END AS change_reason FROM both0),
off0 AS (SELECT *, CASE WHEN balance_penalty IS NOT NULL THEN round(greatest(0, least(100, CASE WHEN balance_risk IS NOT NULL THEN balance_risk * 0.5::DOUBLE + balance_penalty * 0.5::DOUBLE ELSE balance_penalty END)), 4) ELSE balance_risk END AS new_risk,
 CASE WHEN balance_quality IS NOT NULL AND quality IS NOT NULL THEN round(greatest(0, least(100, quality * 0.85::DOUBLE + balance_quality * 0.15::DOUBLE)), 4) ELSE quality END AS new_quality,
 {_MOVED.format(_LEVEL.format('confidence') + ' + CASE WHEN confidence_adjustment >= 5 THEN 1 WHEN confidence_adjustment <= -10 THEN -2 WHEN confidence_adjustment < 0 THEN -1 ELSE 0 END')} AS conf1 FROM exper),
off1 AS (SELECT *, CASE WHEN conf1 <> 'Insufficient' AND severe >= 2 THEN {_MOVED.format(_LEVEL.format('conf1') + ' - 2')} ELSE conf1 END AS new_confidence FROM off0),
official AS (SELECT *, CASE WHEN trap OR signal = 'value-trap-risk' THEN 'value-trap-risk' ELSE {_CLASS.format(c='new_confidence', b='new_risk', q='new_quality')} END AS new_signal FROM off1)"""


@query(OFFICIAL + " SELECT ticker, signal AS previous_signal, new_signal AS signal, new_confidence AS confidence, round(new_quality, 3) AS quality, round(new_risk, 3) AS balance_risk FROM official")
def official_adjustment(spark, sf):
    return S.balance_mode(_with_balance(spark, sf), "official").select("ticker", "previous_signal", "signal", "confidence", _r("quality", 3).alias("quality"), _r("balance_risk", 3).alias("balance_risk"))


@query(OFFICIAL + " SELECT ticker, signal, experimental_signal, experimental_signal <> signal AS would_change, change_reason FROM exper")
def experimental_signal(spark, sf):
    return S.balance_mode(_with_balance(spark, sf), "experimental").select("ticker", "signal", "experimental_signal", "would_change", "change_reason")


@query(OFFICIAL + " SELECT mode, ticker, CASE mode WHEN 'official' THEN new_signal ELSE signal END AS signal FROM official, (SELECT unnest(['off', 'shadow', 'experimental', 'official']) AS mode)")
def scoring_modes(spark, sf):
    rows = written(_with_balance(spark, sf), "with-balance")
    out = None
    for mode in S.MODES:
        one = S.balance_mode(rows, mode).select(F.lit(mode).alias("mode"), "ticker", "signal")
        out = one if out is None else out.unionByName(one)
    return out


@query(OFFICIAL + " SELECT count(*) AS companies, count(*) FILTER (g_liquidity OR g_severe_liquidity) AS liquidity_risk, count(*) FILTER (g_high_leverage OR g_severe_leverage) AS high_leverage, count(*) FILTER (g_negative_equity) AS negative_equity, count(*) FILTER (g_debt_maturity) AS debt_maturity, count(*) FILTER (experimental_signal <> signal OR new_signal <> signal) AS changed, count(*) FILTER (NOT (experimental_signal <> signal OR new_signal <> signal)) AS stable FROM official")
def scoring_change_report(spark, sf):
    return S.scoring_changes(S.balance_mode(_with_balance(spark, sf), "official"))


# ---- joins and set operations ---------------------------------------------------------------------------------------


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def semi_active_roster(spark, sf):
    active = table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf, "supplier").join(active, "s_suppkey", "left_semi").select("s_suppkey")


@query("SELECT c_custkey AS ticker FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_stale(spark, sf):
    return sinks.stale_keys(table(spark, sf, "customer").select(F.col("c_custkey").alias("ticker")), table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("ticker")))


@query("WITH a AS (SELECT o_custkey AS k, max(o_totalprice) AS live FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT c_custkey AS k, c_acctbal AS fallback FROM customer WHERE c_acctbal > 0) SELECT k, coalesce(live, fallback) AS value, live IS NOT NULL AS is_live FROM a FULL JOIN b USING (k)")
def full_outer_coalesce(spark, sf):
    a = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("live"))
    b = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("fallback"))
    return a.join(b, "k", "full_outer").select("k", F.coalesce("live", "fallback").alias("value"), F.col("live").isNotNull().alias("is_live"))


@query(f"WITH {FACTS}, a AS (SELECT entity, arg_max(value, (period_end, accession)) AS v FROM facts WHERE form = 'O' GROUP BY 1), b AS (SELECT entity, arg_max(value, (period_end, accession)) AS v FROM facts WHERE form = 'F' GROUP BY 1) SELECT a.entity, round(b.v - a.v, 2) AS delta, b.v IS NULL AS missing, coalesce(abs(b.v - a.v) >= 15000, false) AS large FROM a LEFT JOIN b USING (entity)")
def baseline_diff(spark, sf):
    f = facts(spark, sf)
    one = lambda form, name: f.where(F.col("form") == form).groupBy("entity").agg(F.max_by("value", F.struct("period_end", "accession")).alias(name))
    j = one("O", "a").join(one("F", "b"), "entity", "left")
    return j.select("entity", _r(F.col("b") - F.col("a"), 2).alias("delta"), F.col("b").isNull().alias("missing"), F.coalesce(F.abs(F.col("b") - F.col("a")) >= 15000, F.lit(False)).alias("large"))


@query("SELECT s_suppkey, m.m AS multiplier, round(s_acctbal * m.m, 4) AS scaled FROM supplier CROSS JOIN (SELECT unnest([0.8::DOUBLE, 1.2::DOUBLE]) AS m) m")
def cross_config(spark, sf):
    return table(spark, sf, "supplier").withColumn("multiplier", F.explode(F.array(F.lit(0.8), F.lit(1.2)))).select("s_suppkey", "multiplier", _r(F.col("s_acctbal") * F.col("multiplier"), 4).alias("scaled"))


@query(f"WITH {BARS}, {FACTS}, d AS (SELECT ticker, day FROM bars WHERE idx >= 126 AND (idx - 126) % 21 = 0) SELECT d.ticker, d.day, count(*) AS known, arg_max(f.value, (f.period_end, f.filed, f.accession)) AS latest_value FROM d JOIN facts f ON f.entity = d.ticker AND f.filed <= d.day GROUP BY 1, 2")
def pit_snapshot_join(spark, sf):
    """The facts known at each of the backtest's signal dates."""
    d = P.snapshots(bars(spark, sf), 21, 126).where("is_snapshot").select("ticker", "day", F.lit(1).alias("ask"))
    f = facts(spark, sf).select(F.col("entity").alias("ticker"), F.col("filed").alias("day"), F.lit(0).alias("ask"), F.struct("period_end", "filed", "accession", "value").alias("fact"))
    # facts and dates in one order: a date sees the facts filed up to it, counted once as they pass
    w = Window.partitionBy("ticker").orderBy("day", "ask").rowsBetween(Window.unboundedPreceding, 0)
    rows = f.unionByName(d, allowMissingColumns=True).withColumn("known", F.count("fact").over(w)).withColumn("latest", F.max("fact").over(w))
    return rows.where("ask = 1 and known > 0").select("ticker", "day", "known", F.col("latest.value").alias("latest_value"))


@query("WITH u AS (SELECT s_nationkey AS k, s_suppkey AS id, 0 AS pri FROM supplier UNION ALL SELECT c_nationkey, c_custkey, 1 FROM customer) SELECT k, id, pri FROM u QUALIFY row_number() OVER (PARTITION BY k, id ORDER BY pri) = 1")
def union_dedupe_priority(spark, sf):
    u = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id"), F.lit(0).alias("pri")).unionByName(table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"), F.lit(1).alias("pri")))
    return u.groupBy("k", "id").agg(F.min("pri").alias("pri"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_missing(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf, "orders").select("o_custkey"))


@query("SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal < 0")
def intersect_keys(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).intersect(table(spark, sf, "customer").where("c_acctbal < 0").select("c_nationkey"))


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def topk_per_group(spark, sf):
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return table(spark, sf, "customer").withColumn("n", n).where("n <= 3").select("c_nationkey", "c_custkey", "c_acctbal")


@query("WITH old AS (SELECT c_custkey AS k, c_acctbal AS v, c_mktsegment AS note FROM customer WHERE c_custkey % 2 = 0), new AS (SELECT c_custkey AS k, c_acctbal + 1 AS v, NULL AS note FROM customer WHERE c_custkey % 3 = 0) SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.v ELSE o.v END AS v, coalesce(n.note, o.note) AS note FROM old o FULL JOIN new n ON o.k = n.k")
def upsert_merge(spark, sf):
    c = table(spark, sf, "customer")
    old = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("note"))
    new = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") + 1).alias("v"), F.lit(None).cast("string").alias("note"))
    return sinks.upsert(old, new, ["k"], ["note"])


@query("SELECT event_id, user_id FROM events e WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id < 100) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def insert_if_absent(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id")
    return sinks.insert_if_absent(e.where("event_id < 100"), e, ["user_id"]).select("event_id", "user_id")


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY CUBE (c_nationkey, c_mktsegment)")
def rollup_cube(spark, sf):
    return table(spark, sf, "customer").cube("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT s_suppkey, rank() OVER w AS rnk, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS quart, round(cume_dist() OVER w, 6) AS cume FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal)")
def ranking_functions(spark, sf):
    w = Window.partitionBy("s_nationkey").orderBy("s_acctbal")
    return table(spark, sf, "supplier").select("s_suppkey", F.rank().over(w).cast("bigint").alias("rnk"), F.dense_rank().over(w).cast("bigint").alias("dense"), F.ntile(4).over(Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")).cast("bigint").alias("quart"), _r(F.cume_dist().over(w)).alias("cume"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS near FROM lineitem GROUP BY 1")
def approx_distinct(spark, sf):
    """The exact numbers, and whether the approximate ones (5 percent, 15 at most) are near them."""
    exact, about = F.count_distinct("l_partkey"), F.approx_count_distinct("l_partkey", 0.05)
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(exact.alias("parts"), (F.abs(about - exact) <= 0.15 * exact).alias("near"))
