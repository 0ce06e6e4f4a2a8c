"""Queries of the application: access, positions, billing, texts around answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspike.functions.exprs import rounded
from marlspike.operators import answers as A
from marlspike.operators import portfolio as U
from marlspike.operators import search as R
from marlspike.sources.tables import table

from .domain import corpus
from .fact_queries import SCORED, _scored
from .registry import query

_STATES = ["active", "trialing", "canceled", "past_due", "odd", "paused"]
SUBS = "subs AS (SELECT o_orderkey, CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_STATES)) + " END AS raw, CAST(o_orderdate AS DATE) + 30 AS period_end, o_orderkey % 4 < 2 AS livemode FROM orders)"


def _subs(spark, sf) -> DataFrame:
    o, raw = table(spark, sf, "orders"), F.lit(None).cast("string")
    for i, s in enumerate(_STATES):
        raw = F.when(F.col("o_orderkey") % 6 == i, F.lit(s)).otherwise(raw)
    return o.select("o_orderkey", raw.alias("raw"), F.date_add(F.col("o_orderdate").cast("date"), 30).alias("period_end"), (F.col("o_orderkey") % 4 < 2).alias("livemode"))


@query(f"WITH {SUBS}, s AS (SELECT *, CASE WHEN raw IN ({', '.join(repr(x) for x in U.STATUSES)}) THEN raw ELSE 'none' END AS status FROM subs) SELECT o_orderkey, status, status IN ('active', 'trialing') OR status = 'canceled' AND period_end > DATE '1998-01-01' AS any_mode, livemode AND (status IN ('active', 'trialing') OR status = 'canceled' AND period_end > DATE '1998-01-01') AS live_only FROM s")
def entitlement(spark, sf):
    s = _subs(spark, sf).withColumn("status", U.subscription_status(F.col("raw")))
    now = F.lit("1998-01-01").cast("date")
    args = (F.col("status"), F.col("period_end"), F.col("livemode"), now)
    return s.select("o_orderkey", "status", U.pro_access(*args).alias("any_mode"), U.pro_access(*args, True).alias("live_only"))


_STOCKS = "stocks AS (SELECT c_custkey AS ticker, c_custkey AS place, c_custkey <= 20 AS preview, CASE WHEN c_acctbal > 9000 THEN 'potentially-undervalued' ELSE 'neutral' END AS signal, CASE WHEN c_acctbal < -500 OR c_acctbal > 9500 THEN 'detected' WHEN c_acctbal < 0 THEN 'emerging' ELSE 'not_detected' END AS trend FROM customer)"


@query(f"""WITH {_STOCKS}, v AS (SELECT * FROM stocks WHERE NOT preview AND signal = 'potentially-undervalued' ORDER BY place LIMIT 3), g AS (SELECT * FROM stocks WHERE NOT preview AND ticker NOT IN (SELECT ticker FROM v) AND trend IN ('detected', 'emerging') ORDER BY place LIMIT 3)
SELECT 'public' AS tier, ticker, 'preview' AS shown_as FROM stocks WHERE preview UNION ALL SELECT 'free', ticker, 'preview' FROM stocks WHERE preview UNION ALL SELECT 'free', ticker, 'undervalued' FROM v UNION ALL SELECT 'free', ticker, 'growth' FROM g""")
def access_tiers(spark, sf):
    b = F.col("c_acctbal")
    s = table(spark, sf, "customer").select(F.col("c_custkey").alias("ticker"), F.col("c_custkey").alias("place"), (F.col("c_custkey") <= 20).alias("preview"), F.when(b > 9000, "potentially-undervalued").otherwise("neutral").alias("signal"), F.when((b < -500) | (b > 9500), "detected").when(b < 0, "emerging").otherwise("not_detected").alias("trend"))
    one = lambda t: U.accessible(s, t).select(F.lit(t).alias("tier"), "ticker", "shown_as")
    return one("public").unionByName(one("free"))


_POS = {
    "quantity_type": "CASE WHEN c_custkey % 2 = 0 THEN 'shares' ELSE 'dollar_amount' END", "shares": "CASE WHEN c_custkey % 10 <> 4 THEN round(c_acctbal / 100, 2) END", "dollar_amount": "CASE WHEN c_custkey % 10 <> 5 THEN c_acctbal END", "average_cost": "CASE WHEN c_custkey % 3 = 0 THEN -1.0 WHEN c_custkey % 3 = 1 THEN 12.5 END",
    "current_price": "CASE WHEN c_custkey % 7 <> 0 THEN 10.0 + c_custkey % 50 END", "horizon_status": "CASE WHEN c_custkey % 5 = 0 THEN 'available' WHEN c_custkey % 5 = 1 THEN 'insufficient_data' WHEN c_custkey % 5 = 2 THEN 'stale' WHEN c_custkey % 5 = 3 THEN 'available' END",
    "base_return": "(c_custkey % 21 - 10) / 100.0", "lower_return": "CASE WHEN c_custkey % 13 <> 0 THEN (c_custkey % 21 - 14) / 100.0 ELSE -1.0 END", "upper_return": "(c_custkey % 21 - 5) / 100.0", "estimated_price": "CASE WHEN c_custkey % 4 < 2 THEN 11.0 + c_custkey % 50 END",
}
_DOUBLE = ["shares", "dollar_amount", "average_cost", "current_price", "base_return", "lower_return", "upper_return", "estimated_price"]


def _positions(spark, sf) -> DataFrame:
    made = {k: F.expr(f"CAST({e} AS DOUBLE)" if k in _DOUBLE else e) for k, e in _POS.items()}
    made["shares"] = F.when(F.col("c_custkey") % 10 != 4, rounded(F.col("c_acctbal") / 100, 2))  # Spark's round takes other halves up than the SQL's
    return table(spark, sf, "customer").select("c_custkey", *[c.alias(k) for k, c in made.items()])


POSITIONS = "pos AS (SELECT c_custkey, " + ", ".join((f"CAST({e} AS DOUBLE)" if k in _DOUBLE else e) + f" AS {k}" for k, e in _POS.items()) + """ FROM customer), p0 AS (SELECT *, CASE WHEN quantity_type = 'shares' THEN CASE WHEN shares > 0 THEN shares END ELSE CASE WHEN dollar_amount > 0 THEN dollar_amount END END AS amount FROM pos),
p1 AS (SELECT *, CASE WHEN amount IS NULL THEN 'Position amount is required' WHEN current_price IS NULL THEN 'Current stock price unavailable' END AS reason, CASE WHEN quantity_type = 'shares' THEN amount ELSE amount / current_price END AS held, CASE WHEN quantity_type = 'shares' THEN amount * current_price ELSE amount END AS position_value,
 CASE WHEN quantity_type = 'shares' AND average_cost >= 0 THEN amount * average_cost END AS cost_basis FROM p0)"""
_M = "floor(({0}) * 100 + 0.5::DOUBLE) / 100"


@query(f"WITH {POSITIONS} SELECT c_custkey, reason, round(held, 6) AS held, round(position_value, 4) AS position_value, round(cost_basis, 4) AS cost_basis, round(position_value - cost_basis, 4) AS unrealized FROM p1")
def position_values(spark, sf):
    r = lambda c, d=4: rounded(c, d).alias(c)
    return U.position_value(_positions(spark, sf)).select("c_custkey", "reason", r("held", 6), r("position_value"), r("cost_basis"), r("unrealized"))


@query(f"""WITH {POSITIONS}, q AS (SELECT *, base_return > -1 AND lower_return > -1 AND upper_return > -1 AS whole, coalesce(estimated_price, current_price * (1 + base_return)) AS sell FROM p1), u AS (SELECT *, coalesce(reason, CASE WHEN horizon_status IS NULL THEN 'Projection source unavailable' WHEN horizon_status = 'insufficient_data' THEN 'Not enough historical data' WHEN horizon_status = 'stale' AND NOT (whole AND estimated_price > 0 IS TRUE) THEN 'Historical scenario is stale' WHEN NOT whole THEN 'Projection return unavailable' END) AS unavailable_reason FROM q)
SELECT c_custkey, CASE WHEN unavailable_reason IS NULL THEN 'available' ELSE 'unavailable' END AS status, unavailable_reason, CASE WHEN unavailable_reason IS NULL THEN {_M.format('sell - current_price')} END AS gain_per_share, CASE WHEN unavailable_reason IS NULL THEN {_M.format('held * (sell - current_price)')} END AS gain, CASE WHEN unavailable_reason IS NULL THEN {_M.format('held * sell')} END AS outcome_value FROM u""")
def position_outcomes(spark, sf):
    return U.projected(U.position_value(_positions(spark, sf))).select("c_custkey", "status", "unavailable_reason", "gain_per_share", "gain", "outcome_value")


@query("""SELECT c_custkey, CASE WHEN trim(name) = '' THEN 'Ticker is required.' WHEN NOT shares > 0 THEN 'Shares must be greater than zero.' WHEN NOT dollars > 0 THEN 'Dollar amount must be greater than zero.' WHEN NOT cost >= 0 THEN 'Average cost cannot be negative.' WHEN NOT r30 BETWEEN -1 AND 10 THEN '30-day return estimate must be between -100% and +1000%.' WHEN NOT r90 BETWEEN -1 AND 10 THEN '90-day return estimate must be between -100% and +1000%.'
 WHEN kind = 'shares' AND shares IS NULL THEN 'Share-based positions require shares.' WHEN kind = 'dollar_amount' AND dollars IS NULL THEN 'Dollar-based positions require a dollar amount.' END AS error, regexp_matches(upper(trim(name)), '^[A-Z0-9.-]{1,12}$') AS ticker_ok
 FROM (SELECT c_custkey, CASE WHEN c_custkey % 19 = 0 THEN ' ' WHEN c_custkey % 19 = 1 THEN 'a b' ELSE substr(c_name, 1, 8) END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'shares' ELSE 'dollar_amount' END AS kind, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS shares, CASE WHEN c_custkey % 5 < 3 THEN c_acctbal END AS dollars, CASE WHEN c_custkey % 11 = 0 THEN -1.0 WHEN c_custkey % 11 < 6 THEN 3.0 END AS cost, CASE WHEN c_custkey % 23 = 0 THEN 11.0 WHEN c_custkey % 23 < 9 THEN 0.5 END AS r30, CASE WHEN c_custkey % 29 = 0 THEN -2.0 END AS r90 FROM customer)""")
def portfolio_validation(spark, sf):
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    p = table(spark, sf, "customer").select("c_custkey", F.when(k % 19 == 0, " ").when(k % 19 == 1, "a b").otherwise(F.substring("c_name", 1, 8)).alias("ticker"), F.when(k % 2 == 0, "shares").otherwise("dollar_amount").alias("quantity_type"), F.when(k % 3 == 0, b).alias("shares"), F.when(k % 5 < 3, b).alias("dollar_amount"),
                                            F.when(k % 11 == 0, -1.0).when(k % 11 < 6, 3.0).alias("average_cost"), F.when(k % 23 == 0, 11.0).when(k % 23 < 9, 0.5).alias("return_30"), F.when(k % 29 == 0, -2.0).alias("return_90"))
    return p.select("c_custkey", U.input_error(p).alias("error"), U.ticker_format(F.col("ticker")).alias("ticker_ok"))


@query("""WITH f AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'zero-return baseline' WHEN p_size % 4 = 1 THEN 'ridge' ELSE 'huber' END AS m30, CASE WHEN p_size % 3 = 0 THEN 'market-return baseline' ELSE 'ridge' END AS m90, p_size % 5 <> 0 AS c30, p_size % 7 <> 0 AS c90, CASE WHEN p_size % 6 = 0 THEN NULL WHEN p_size % 6 = 1 THEN 0 ELSE p_retailprice END AS price FROM part)
SELECT p_partkey, CASE WHEN m30 NOT LIKE '%baseline' AND m90 NOT LIKE '%baseline' AND c30 AND c90 THEN 'forecast_model' WHEN price > 0 THEN 'conservative_historical_scenario' ELSE 'unavailable' END AS source FROM f""")
def projection_source(spark, sf):
    n = F.col("p_size")
    f = table(spark, sf, "part").select("p_partkey", F.when(n % 4 == 0, "zero-return baseline").when(n % 4 == 1, "ridge").otherwise("huber").alias("model_30"), F.when(n % 3 == 0, "market-return baseline").otherwise("ridge").alias("model_90"), (n % 5 != 0).alias("complete_30"), (n % 7 != 0).alias("complete_90"), F.when(n % 6 == 0, None).when(n % 6 == 1, 0.0).otherwise(F.col("p_retailprice")).alias("scenario_price"))
    return f.select("p_partkey", U.projection_source(f).alias("source"))


@query("""WITH t AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN NULL WHEN 1 THEN 'unsupported' WHEN 2 THEN 'stale' WHEN 3 THEN 'horizon_unknown' WHEN 4 THEN 'insufficient_data' ELSE 'available' END AS status, CASE WHEN p_size % 5 <> 0 THEN p_retailprice END AS mean, CASE WHEN p_size % 4 <> 0 THEN 900.0::DOUBLE END AS price, CASE WHEN p_size % 7 <> 0 THEN 365 END AS days FROM part)
SELECT p_partkey, reason, CASE WHEN reason IS NULL THEN round(pow(mean / price, 30.0::DOUBLE / days) - 1, 6) END AS return_30, CASE WHEN reason IS NULL THEN round(pow(mean / price, 90.0::DOUBLE / days) - 1, 6) END AS return_90 FROM (SELECT *, CASE WHEN status IS NULL OR status = 'unsupported' THEN 'Analyst target data is not currently available.' WHEN status = 'stale' THEN 'Analyst target is stale' WHEN status = 'horizon_unknown' THEN 'Analyst target horizon not supplied'
 WHEN status = 'insufficient_data' OR mean IS NULL THEN 'Analyst target unavailable for this stock' WHEN price IS NULL THEN 'Current stock price unavailable' WHEN days IS NULL THEN 'Analyst target horizon not supplied' END AS reason FROM t)""")
def target_outcomes(spark, sf):
    n = F.col("p_size")
    status = F.when(n % 6 == 1, "unsupported").when(n % 6 == 2, "stale").when(n % 6 == 3, "horizon_unknown").when(n % 6 == 4, "insufficient_data").when(n % 6 == 5, "available")
    t = table(spark, sf, "part").select("p_partkey", status.alias("target_status"), F.when(n % 5 != 0, F.col("p_retailprice")).alias("target_mean"), F.when(n % 4 != 0, 900.0).alias("target_price"), F.when(n % 7 != 0, 365).alias("target_days"))
    t = t.withColumn("reason", U.target_reason())
    return t.select("p_partkey", "reason", *[F.when(F.col("reason").isNull(), F.round(U.scaled_return(d), 6)).alias(f"return_{d}") for d in (30, 90)])


@query("SELECT o_orderkey, strftime(o_orderdate, '%b %-d, %Y') AS day, CASE WHEN q IS NULL THEN 'Unavailable' WHEN q = floor(q) THEN format('{:,}', q::BIGINT) WHEN q < 1 THEN printf('%.4f', q) WHEN q < 10 THEN printf('%.3f', q) ELSE regexp_replace(printf('%.2f', q), '\\.?0+$', '') END AS shares FROM (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN (o_orderkey * 100)::DOUBLE WHEN o_orderkey % 5 = 2 THEN (o_orderkey % 64) / 64.0::DOUBLE + 0.0078125::DOUBLE ELSE o_orderkey / 7.0::DOUBLE + 0.5::DOUBLE END AS q FROM orders)")
def display_formats(spark, sf):
    k = F.col("o_orderkey")
    q = F.when(k % 5 == 0, None).when(k % 5 == 1, (k * 100).cast("double")).when(k % 5 == 2, (k % 64) / 64.0 + 0.0078125).otherwise(k / 7.0 + 0.5)
    return table(spark, sf, "orders").withColumn("q", q).select("o_orderkey", U.display_date(F.col("o_orderdate")).alias("day"), U.share_quantity(F.col("q")).alias("shares"))


_TYPES = ["checkout.session.completed", "checkout.session.async_payment_failed", "invoice.paid", "invoice.payment_failed", "customer.subscription.updated", "charge.refunded"]


@query("""WITH e AS (SELECT event_id % 400 AS event_id, event_id AS received, CASE event_id % 6 """ + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TYPES)) + """ END AS type, user_id, value FROM events), f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY received) = 1),
s AS (SELECT event_id, CASE WHEN user_id % 9 = 0 THEN NULL ELSE 'u' || user_id END AS u, 'c' || user_id AS ref, type, CASE type WHEN 'checkout.session.async_payment_failed' THEN 'unpaid' WHEN 'checkout.session.completed' THEN CASE event_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'unpaid' ELSE 'incomplete' END WHEN 'invoice.paid' THEN 'active' WHEN 'invoice.payment_failed' THEN 'past_due' WHEN 'customer.subscription.updated' THEN CASE event_id % 2 WHEN 0 THEN 'trialing' ELSE 'none' END END AS status FROM f)
SELECT event_id, CASE WHEN type LIKE 'checkout%' THEN coalesce(u, ref) ELSE u END AS "user", status, CASE WHEN type LIKE 'customer%' THEN event_id * 1000 + 1 END AS period_end_s FROM s WHERE status IS NOT NULL AND CASE WHEN type LIKE 'checkout%' THEN coalesce(u, ref) ELSE u END IS NOT NULL""")
def webhook_changes(spark, sf):
    e, kind = table(spark, sf, "events"), F.lit(None).cast("string")
    for i, t in enumerate(_TYPES):
        kind = F.when(F.col("event_id") % 6 == i, F.lit(t)).otherwise(kind)
    n = F.col("event_id") % 400
    body = F.to_json(F.struct(F.when(F.col("user_id") % 9 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("user"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("client_reference_id"), F.when(n % 3 == 0, "paid").when(n % 3 == 1, "unpaid").otherwise("open").alias("payment_status"),
                              F.when(n % 2 == 0, "trialing").otherwise("strange").alias("status"), (n * 1000 + 1).cast("double").alias("current_period_end")))
    rows = e.select(n.alias("event_id"), F.col("event_id").alias("received"), kind.alias("type"), body.alias("body"))
    return U.subscription_change(rows).select("event_id", "user", "status", F.unix_seconds("period_end").alias("period_end_s"))


# ---- answers --------------------------------------------------------------------------------------------------------

_TAIL = "CASE conv_id % 6 WHEN 0 THEN ' You should buy it [id1].' WHEN 1 THEN ' It cannot predict whether the stock will go up or down [id1].' WHEN 2 THEN chr(10) || 'Evidence_Relevance: only partial' WHEN 3 THEN chr(10) || 'Signal Relationship: strong support for momentum and risk [id1]' WHEN 4 THEN chr(10) || 'evidence assessment: Mixed' ELSE '' END"
ANSWERS = f"answers AS (SELECT conv_id, turn, coalesce(text, '') || {_TAIL} AS a, CASE conv_id % 4 WHEN 0 THEN 'risk_outlook' WHEN 1 THEN 'margin_pressure' ELSE 'general' END AS intent, CASE turn % 2 WHEN 0 THEN 'momentum-risk' END AS signal FROM conversations WHERE role = 'assistant')"


def _answers(spark, sf) -> DataFrame:
    k = F.col("conv_id") % 6
    tail = F.when(k == 0, " You should buy it [id1].").when(k == 1, " It cannot predict whether the stock will go up or down [id1].").when(k == 2, "\nEvidence_Relevance: only partial").when(k == 3, "\nSignal Relationship: strong support for momentum and risk [id1]").when(k == 4, "\nevidence assessment: Mixed").otherwise("")
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    return c.select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), tail).alias("a"), F.when(F.col("conv_id") % 4 == 0, "risk_outlook").when(F.col("conv_id") % 4 == 1, "margin_pressure").otherwise("general").alias("intent"), F.when(F.col("turn") % 2 == 0, "momentum-risk").alias("signal"))


@query(f"""WITH {ANSWERS}, w AS (SELECT *, regexp_matches(a, '(?i)\\b(buy|sell|hold|guaranteed upside|this stock will go (?:up|down))\\b') AS bad FROM answers) SELECT conv_id, turn, CASE WHEN bad THEN 'withheld' WHEN NOT contains(a, 'id1') THEN 'no citation' END AS warning, length(CASE WHEN bad THEN '{A.WITHHELD}' ELSE a END) AS shown,
 intent = 'risk_outlook' AND a <> '' AND NOT contains(lower(a), 'cannot predict whether the stock will go up or down') AS prefaced FROM w""")
def answer_safety(spark, sf):
    rows = _answers(spark, sf).withColumn("v", A.validated(F.col("a"), F.array(F.lit("id1"))))
    return rows.select("conv_id", "turn", F.col("v.warning").alias("warning"), F.length("v.answer").cast("bigint").alias("shown"), (A.with_preface(F.col("a"), F.col("intent")) != F.col("a")).alias("prefaced"))


_LINE = "list_filter(string_split(a, chr(10)), lambda x: contains(x, ':') AND replace(lower(trim(split_part(x, ':', 1))), '_', ' ') IN ({0}))[1]"
_FIELD = "lower(coalesce(trim(substr({0}, instr({0}, ':') + 1)), ''))"


@query(f"""WITH {ANSWERS}, l AS (SELECT *, {_LINE.format("'evidence relevance'")} AS lr, {_LINE.format("'signal relationship'")} AS ls, {_LINE.format("'evidence assessment'")} AS la FROM answers), f AS (SELECT *, {_FIELD.format('lr')} AS r, {_FIELD.format('ls')} AS s, {_FIELD.format('la')} AS e FROM l),
n AS (SELECT *, CASE WHEN contains(r, 'direct') THEN 'Directly relevant to question' WHEN contains(r, 'partial') THEN 'Partially relevant' WHEN contains(r, 'weak') THEN 'Weakly relevant' ELSE 'Insufficient evidence' END AS relevance,
 CASE WHEN contains(s, 'review') THEN 'Review recommended' WHEN contains(s, 'indirect') THEN 'Indirect relationship' WHEN contains(s, 'not enough') OR contains(s, 'insufficient') THEN 'Not enough evidence to connect to signal' WHEN contains(s, 'weak') THEN 'Weakens signal' WHEN contains(s, 'mixed') OR contains(s, 'complicat') THEN 'Mixed' WHEN contains(s, 'support') THEN 'Supports signal' ELSE 'Not enough evidence to connect to signal' END AS claimed,
 CASE WHEN e = 'mixed evidence' THEN 'Mixed evidence' WHEN contains(e, 'review') THEN 'Review recommended' WHEN contains(e, 'weak') OR contains(e, 'contradict') THEN 'Weakens signal' WHEN contains(e, 'support') THEN 'Supports signal' WHEN contains(e, 'mixed') OR contains(e, 'complicat') THEN 'Mixed evidence' ELSE 'Insufficient evidence' END AS assessment FROM f)
SELECT conv_id, turn, relevance, assessment, claimed, CASE WHEN claimed IN ('Supports signal', 'Weakens signal') AND intent NOT IN ('risk_outlook', 'general') AND NOT (signal IS NOT NULL AND contains(lower(a), 'momentum')) THEN 'Indirect relationship' ELSE claimed END AS relationship FROM n""")
def label_normalize(spark, sf):
    rows = _answers(spark, sf).withColumns({"relevance": A.relevance(A.named_field(F.col("a"), ["Evidence Relevance"])), "claimed": A.relationship(A.named_field(F.col("a"), ["Signal Relationship"])), "assessment": A.assessment(A.named_field(F.col("a"), ["Evidence Assessment"]))})
    return rows.select("conv_id", "turn", "relevance", "assessment", "claimed", A.guarded_relationship(F.col("intent"), F.col("claimed"), F.col("signal"), F.col("a")).alias("relationship"))


_KW = "".join(f" WHEN {' OR '.join(f"contains(lower(query), '{w}')" for w in ws)} THEN '{n}'" for n, ws in R.KEYWORDS.items())


@query(f"""WITH q AS (SELECT item_id AS query_id, text || CASE item_id % 5 WHEN 0 THEN ' will it go up' WHEN 1 THEN ' the gross margin' WHEN 2 THEN ' is it cheap' ELSE '' END AS query FROM benchmark), i AS (SELECT *, CASE WHEN regexp_matches(lower(query), '{'|'.join(R.OUTLOOK)}') THEN 'risk_outlook'{_KW} ELSE 'general' END AS intent FROM q)
SELECT query_id, intent, 'primary' AS kind, query FROM i UNION ALL SELECT query_id, intent, 'risk', query || ' {A.RISK_QUERY}' FROM i WHERE intent = 'risk_outlook' UNION ALL SELECT query_id, intent, 'support', query || ' {A.SUPPORT_QUERY}' FROM i WHERE intent = 'risk_outlook'
UNION ALL SELECT query_id, intent, 'intent', query || ' ' || CASE intent {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in A.BUNDLES.items())} END FROM i WHERE intent NOT IN ('risk_outlook', 'general')""")
def query_expansion(spark, sf):
    k = F.col("item_id") % 5
    tail = F.when(k == 0, " will it go up").when(k == 1, " the gross margin").when(k == 2, " is it cheap").otherwise("")
    return A.retrieval_queries(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", tail).alias("query")))


@query("""WITH t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'assistant' AND turn % 5 <> 4) SELECT conv_id, 'T' AS ticker, string_agg('Prior intent: general; question: ' || coalesce(text, 'unknown') || '; themes: Weakly relevant / unknown; previous chunk IDs: ' || CASE WHEN turn % 3 = 0 THEN 'none' ELSE 'a' || turn || ', b, c, d' END || '.', chr(10) ORDER BY turn) AS summary FROM t WHERE n <= 3 GROUP BY conv_id""")
def session_summary(spark, sf):
    turn = F.col("turn").cast("string")
    c = table(spark, sf, "conversations").select("conv_id", F.lit("T").alias("ticker"), "turn", "role", F.when(F.col("turn") % 5 == 4, "failed").alias("error"), F.lit(None).cast("string").alias("intent"), F.col("text").alias("query"), F.lit("Weakly relevant").alias("relevance"), F.lit(None).cast("string").alias("relationship"),
                                                 F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("a"), turn), F.lit("b"), F.lit("c"), F.lit("d"), F.lit("e"))).alias("citations"))
    return A.session_summary(c)


@query(SCORED + " SELECT ticker, CASE WHEN greatest(coalesce(market_risk, 0), coalesce(balance_risk, 0), coalesce(momentum_risk, 0)) >= 75 THEN 'elevated risk' WHEN value >= 65 AND quality >= 55 THEN 'supportive' WHEN coalesce(value, quality, market_risk, balance_risk, momentum_risk) IS NOT NULL THEN 'mixed' ELSE 'insufficient' END AS posture, array_to_string(list_filter([CASE WHEN market_risk >= 70 THEN 'Elevated market risk score' END, CASE WHEN balance_risk >= 70 THEN 'Elevated balance-sheet risk score' END, CASE WHEN momentum_risk >= 70 THEN 'Elevated momentum-risk score' END, CASE WHEN momentum_risk >= 70 THEN 'MOMENTUM_RISK_HIGH' END, CASE WHEN market_risk >= 70 THEN 'MARKET_RISK_HIGH' END, CASE WHEN balance_risk >= 70 THEN 'BALANCE_SHEET_RISK_HIGH' END], lambda x: x IS NOT NULL), ',') AS gates FROM scored")
def risk_posture(spark, sf):
    from marlspike.operators.scoring import reason_codes

    c = F.col
    s = _scored(spark, sf)
    gates = A.risk_gates({"Elevated market risk score": c("market_risk"), "Elevated balance-sheet risk score": c("balance_risk"), "Elevated momentum-risk score": c("momentum_risk")}, reason_codes())
    return s.select("ticker", A.risk_posture(c("value"), c("quality"), [c("market_risk"), c("balance_risk"), c("momentum_risk")]).alias("posture"), F.array_join(gates, ",").alias("gates"))


@query("SELECT name, CASE name WHEN 'quick' THEN 3 ELSE 8 END AS passages, CASE name WHEN 'quick' THEN 4000 ELSE 12000 END AS context_chars, CASE name WHEN 'quick' THEN 300 ELSE 900 END AS answer_tokens FROM (SELECT DISTINCT CASE WHEN conv_id % 3 = 0 THEN 'quick' WHEN conv_id % 3 = 1 THEN 'deep' ELSE 'other' END AS name FROM conversations)")
def depth_profiles(spark, sf):
    k = F.col("conv_id") % 3
    names = table(spark, sf, "conversations").select(F.when(k == 0, "quick").when(k == 1, "deep").otherwise("other").alias("name")).distinct()
    return names.select("name", A.depth(F.col("name")).alias("d")).select("name", "d.*")


@query("""WITH s AS (SELECT label, count(*) AS n, sha256(string_agg(vec_id::VARCHAR, chr(10) ORDER BY vec_id)) AS h, count(*) FILTER (len(embedding) <> 64) AS bad FROM embeddings GROUP BY label) SELECT label, array_to_string(list_filter([CASE WHEN label % 2 = 1 THEN 'corpus hash changed' END, CASE WHEN label % 3 = 1 THEN 'embedding model changed' END, CASE WHEN label % 4 = 1 THEN 'chunk IDs or ordering changed' END, CASE WHEN label % 5 = 1 THEN 'vector count differs' END, CASE WHEN bad > 0 THEN 'vector dimensions differ' END], lambda x: x IS NOT NULL), ';') AS reasons FROM s""")
def cache_validation(spark, sf):
    hashed = lambda x: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(x)), lambda v: v.cast("string")), "\n"), 256)
    # ids are hashed by ranges first, so that no row holds a label's
    e = table(spark, sf, "embeddings").groupBy("label", (F.col("vec_id") / 4096).cast("long").alias("range")).agg(F.count(F.lit(1)).alias("n"), F.concat_ws(":", F.lpad(F.col("range").cast("string"), 20, "0"), hashed("vec_id")).alias("part"), F.count_if(F.size("embedding") != 64).alias("bad"))
    e = e.groupBy("label").agg(F.sum("n").alias("stored_n"), hashed("part").alias("stored_ids_hash"), F.sum("bad").alias("bad_dimensions"))
    k = F.col("label")
    e = e.withColumns({"stored_corpus_hash": F.lit("a"), "stored_model": F.lit("m"), "wanted_corpus_hash": F.when(k % 2 == 1, "b").otherwise("a"), "wanted_model": F.when(k % 3 == 1, "n").otherwise("m"), "wanted_ids_hash": F.when(k % 4 == 1, "x").otherwise(F.col("stored_ids_hash")), "wanted_n": F.col("stored_n") + F.when(k % 5 == 1, 1).otherwise(0)})
    return e.select("label", F.array_join(A.cache_reasons(e, e), ";").alias("reasons"))


@query()
def rag_answers(spark, sf):
    """Each test item as a question, answered by its own best passages (the generator is a plain column here)."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return A.answer_questions(corpus(spark, sf), q, lambda prompt: F.concat(F.lit("Evidence: "), prompt))
