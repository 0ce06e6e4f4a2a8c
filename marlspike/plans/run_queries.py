"""Queries over pipeline runs: failures, stages, checkpoints, incremental refresh, readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspike.operators import health as H
from marlspike.operators import refresh as N
from marlspike.sources import sinks
from marlspike.sources import tables as TB
from marlspike.sources.scratch import fresh_path, written
from marlspike.sources.tables import table

from .domain import BARS, FACTS, bars, facts
from .price_queries import OBS, observations
from .registry import query

_TEXTS = ["HTTP Error 404: Not Found", "HTTP Error 503: busy", "no CompanyFacts payload", "price rows are empty", "Chart payload broken", "unknown CIK", "timed out"]
MESSAGES = "messages AS (SELECT event_id, user_id, CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TEXTS)) + " END || ' / ' || event_type AS message FROM events)"
REASON = """CASE WHEN contains(t, 'HTTP Error 404') THEN 'PROVIDER_HTTP_404' WHEN regexp_matches(t, 'HTTP Error (429|500|502|503|504)') THEN 'PROVIDER_RETRYABLE_HTTP_ERROR' WHEN contains(lower(t), 'companyfacts') THEN 'SEC_COMPANYFACTS_UNAVAILABLE'
 WHEN contains(lower(t), 'price') OR contains(lower(t), 'chart') THEN 'PRICE_HISTORY_UNAVAILABLE' WHEN contains(lower(t), 'cik') THEN 'TICKER_CIK_MAPPING_MISSING' ELSE 'PROVIDER_REQUEST_FAILED' END"""


def _messages(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    text = F.lit(None).cast("string")
    for i, t in reversed(list(enumerate(_TEXTS))):
        text = F.when(F.col("event_id") % 8 == i, F.lit(t)).otherwise(text)
    return e.select("event_id", "user_id", F.concat(text, F.lit(" / "), F.col("event_type")).alias("message"))


@query(f"WITH {MESSAGES}, r AS (SELECT reason, count(*) AS n FROM (SELECT {REASON} AS reason FROM (SELECT coalesce(message, '') AS t FROM messages)) GROUP BY 1) SELECT reason, reason NOT IN ('PROVIDER_HTTP_404', 'TICKER_CIK_MAPPING_MISSING') AS retryable, n, row_number() OVER (ORDER BY n DESC, reason) AS place FROM r")
def failure_reasons(spark, sf):
    return H.histogram(_messages(spark, sf)).select("reason", "retryable", "n", F.col("place").cast("bigint").alias("place"))


_RUN = {
    "core_expected": "8", "core_missing": "CASE WHEN run % 9 = 0 THEN 1 ELSE 0 END", "etl_requested": "n", "etl_succeeded": "positive", "etl_failed": "CASE WHEN run % 3 = 0 THEN n - positive ELSE 0 END", "backtest_skipped": "run % 4 = 0", "backtest_complete": "run % 4 = 1",
    "backtest_snapshots": "2 * n", "backtest_observations": "rich", "forecasts": "CASE WHEN run % 11 = 10 THEN 0 ELSE n END", "forecasts_unavailable": "CASE WHEN run % 11 = 10 THEN 0 ELSE n - positive END", "forecasts_short": "n - rich", "search_docs": "CASE WHEN run % 13 = 12 THEN 0 ELSE 3 * n END", "search_tickers": "n",
    "balance_available": "building", "balance_partial": "CASE WHEN run % 2 = 0 THEN machinery ELSE 0 END", "balance_unavailable": "CASE WHEN run % 2 = 0 THEN furniture ELSE 0 END", "balance_fallback": "n", "trend_mode": "CASE WHEN run % 5 = 0 THEN 'off' ELSE 'display' END", "trend_attempted": "n", "trend_judged": "n - 1", "trend_unavailable": "1",
    "trend_failures": "CASE WHEN run % 7 = 3 THEN 2 ELSE 0 END",
}
RUNS = f"""counted AS (SELECT c_nationkey AS run, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS positive, count(*) FILTER (c_acctbal > 5000) AS rich, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_mktsegment = 'MACHINERY') AS machinery, count(*) FILTER (c_mktsegment = 'FURNITURE') AS furniture FROM customer GROUP BY 1),
runs AS (SELECT run, {', '.join(f'{e} AS {k}' for k, e in _RUN.items())} FROM counted),
stages AS (SELECT run, 'core_artifacts' AS name, CASE WHEN core_missing > 0 THEN 'failed' ELSE 'success' END AS status, core_expected AS attempted, core_expected - core_missing AS succeeded, core_missing AS failed, 0 AS skipped, core_missing AS reasons FROM runs
 UNION ALL SELECT run, 'etl_ticker_pipeline', CASE WHEN etl_requested > 0 AND etl_failed = 0 THEN 'success' WHEN etl_requested > 0 AND etl_succeeded > 0 THEN 'partial_success' ELSE 'failed' END, etl_requested, etl_succeeded, etl_failed, 0, etl_failed FROM runs
 UNION ALL SELECT run, 'backtest', CASE WHEN backtest_skipped THEN 'unavailable_expected' WHEN backtest_complete THEN 'success' ELSE 'partial_success' END, backtest_snapshots, backtest_observations, 0, backtest_skipped::INT, backtest_skipped::INT FROM runs
 UNION ALL SELECT run, 'forecast_artifacts', CASE WHEN forecasts = 0 THEN 'failed' ELSE 'success' END, forecasts, greatest(0, forecasts - forecasts_unavailable), 0, forecasts_unavailable, forecasts_short + forecasts_unavailable FROM runs
 UNION ALL SELECT run, 'filing_search_index', CASE WHEN search_docs > 0 AND search_tickers > 0 THEN 'success' ELSE 'failed' END, search_tickers, search_tickers, (search_docs = 0 OR search_tickers = 0)::INT, 0, (search_docs = 0)::INT FROM runs
 UNION ALL SELECT run, 'balance_sheet_context', CASE WHEN balance_partial + balance_unavailable > 0 THEN 'partial_success' ELSE 'success' END, CASE WHEN balance_available + balance_partial + balance_unavailable > 0 THEN balance_available + balance_partial + balance_unavailable ELSE balance_fallback END, balance_available + balance_partial, 0, balance_unavailable, balance_partial + balance_unavailable FROM runs
 UNION ALL SELECT run, 'growth_spurt_detector', CASE WHEN trend_mode = 'off' THEN 'unavailable_expected' WHEN trend_attempted = 0 THEN 'failed' WHEN trend_failures > 0 THEN 'partial_success' ELSE 'success' END, CASE WHEN trend_mode = 'off' THEN 0 ELSE trend_attempted END, CASE WHEN trend_mode = 'off' THEN 0 ELSE trend_judged END, CASE WHEN trend_mode = 'off' THEN 0 ELSE trend_failures END, CASE WHEN trend_mode = 'off' THEN 1 ELSE trend_unavailable END, CASE WHEN trend_mode = 'off' THEN 1 ELSE trend_unavailable + trend_failures END FROM runs
 UNION ALL SELECT run, 'market_targets', 'unavailable_expected', forecasts, 0, 0, forecasts, greatest(forecasts, 1) FROM runs)"""


def _runs(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("run")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("positive"), F.count_if(F.col("c_acctbal") > 5000).alias("rich"), *[F.count_if(F.col("c_mktsegment") == s.upper()).alias(s) for s in ("building", "machinery", "furniture")])
    return c.select("run", *[F.expr(e).alias(k) for k, e in _RUN.items()])


@query(f"WITH {RUNS} SELECT run, name, status, attempted::BIGINT AS attempted, succeeded::BIGINT AS succeeded, failed::BIGINT AS failed, skipped::BIGINT AS skipped, reasons::BIGINT AS reasons FROM stages")
def health_stages(spark, sf):
    return H.stages(_runs(spark, sf))


@query(f"""WITH {RUNS}, g AS (SELECT run, bool_or(status = 'failed') AS any_failed, coalesce(sum(failed) FILTER (name = 'etl_ticker_pipeline'), 0) AS etl, coalesce(sum(failed) FILTER (name = 'core_artifacts'), 0) AS critical, coalesce(sum(failed) FILTER (name <> 'core_artifacts'), 0) AS noncritical, coalesce(sum(skipped) FILTER (status = 'unavailable_expected'), 0) AS expected,
 coalesce(sum(reasons) FILTER (status = 'partial_success' AND failed = 0), 0) AS soft, coalesce(sum(reasons) FILTER (status = 'failed' OR status = 'partial_success' AND failed = 0), 0) AS warned FROM stages GROUP BY run), s AS (SELECT *, CASE WHEN critical > 0 OR any_failed THEN 'failed' WHEN etl > 0 THEN 'partial_success' ELSE 'success' END AS status FROM g)
SELECT run, status, CASE status WHEN 'failed' THEN 'blocked' WHEN 'partial_success' THEN 'ready_with_known_limitations' ELSE 'ready' END AS readiness, critical::BIGINT AS critical, noncritical::BIGINT AS noncritical, expected::BIGINT AS expected_unavailable, soft::BIGINT AS quality_warnings, warned::BIGINT AS warnings FROM s""")
def health_rollup(spark, sf):
    return H.overall(H.stages(_runs(spark, sf)))


BATCHES = """batches AS (SELECT start, CASE WHEN start % 100 = 0 THEN 'complete' WHEN start % 175 = 50 THEN 'partial' END AS status, count(*) + CASE WHEN start % 125 = 100 THEN 1 ELSE 0 END AS attempted, count(*) FILTER (c_acctbal >= 0) AS succeeded, count(*) FILTER (c_acctbal < 0) AS failed
 FROM (SELECT *, (c_custkey - 1) - (c_custkey - 1) % 25 AS start FROM customer) WHERE start % 400 <> 375 GROUP BY start UNION ALL SELECT 7, 'complete', 1, 1, 0)"""


@query(f"""WITH {BATCHES}, want AS (SELECT unnest(range(0, (SELECT count(*) FROM customer), 25)) AS start), known AS (SELECT *, CASE WHEN status = 'complete' THEN true WHEN status = 'partial' THEN false ELSE attempted > 0 AND succeeded + failed >= attempted END AS done FROM batches),
j AS (SELECT w.start AS w, k.start AS k, done, attempted, succeeded, failed FROM want w FULL JOIN known k ON w.start = k.start), g AS (SELECT count(w) AS expected, count(*) FILTER (w IS NOT NULL AND done) AS completed, count(*) FILTER (k IS NULL) AS missing, count(*) FILTER (w IS NULL) AS unexpected,
 coalesce(sum(attempted) FILTER (w IS NOT NULL AND done), 0)::BIGINT AS attempted, coalesce(sum(succeeded) FILTER (w IS NOT NULL AND done), 0)::BIGINT AS succeeded, coalesce(sum(failed) FILTER (w IS NOT NULL), 0)::BIGINT AS failed FROM j) SELECT *, missing = 0 AND completed >= expected AND attempted >= (SELECT count(*) FROM customer) AS complete FROM g""")
def checkpoint_gate(spark, sf):
    c = table(spark, sf, "customer")
    start = (F.col("c_custkey") - 1) - (F.col("c_custkey") - 1) % 25
    b = c.withColumn("start", start).where("start % 400 <> 375").groupBy("start").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") >= 0).alias("succeeded"), F.count_if(F.col("c_acctbal") < 0).alias("failed"))
    b = b.select("start", F.when(F.col("start") % 100 == 0, "complete").when(F.col("start") % 175 == 50, "partial").alias("status"), (F.col("n") + F.when(F.col("start") % 125 == 100, 1).otherwise(0)).alias("attempted"), "succeeded", "failed")
    b = b.unionByName(spark.createDataFrame([(7, "complete", 1, 1, 0)], "start long, status string, attempted long, succeeded long, failed long"))
    return H.checkpoint_gate(b, c.count(), 25)


@query("WITH u AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS place, count(*) OVER () AS n FROM supplier) SELECT 'T' || s_suppkey AS ticker, (place - 7 + n) % n AS slot, least(n, 8) AS requested, (7 + least(n, 8)) % n AS next_offset FROM u WHERE (place - 7 + n) % n < least(n, 8)")
def refresh_batch(spark, sf):
    u = table(spark, sf, "supplier").select(F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("ticker"), F.col("s_suppkey").alias("cik"))
    chosen, state = N.select_batch(written(N.numbered(u), "universe"), {"next_offset": 7}, 4, 2)
    return chosen.select("ticker", F.col("slot").cast("bigint").alias("slot"), F.lit(min(state["size"], 8)).cast("bigint").alias("requested"), F.lit(state["next_offset"]).cast("bigint").alias("next_offset"))


@query("""WITH old AS (SELECT n_nationkey AS ticker, n_nationkey AS place, n_name AS name FROM nation), new AS (SELECT n_nationkey AS ticker, n_nationkey AS place, 'new ' || n_name AS name FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 100 + r_regionkey, 100 + r_regionkey, r_name FROM region)
SELECT coalesce(n.ticker, o.ticker) AS ticker, coalesce(o.place, (SELECT max(place) FROM old) + 1 + n.place)::INT AS place, CASE WHEN n.ticker IS NOT NULL THEN n.name ELSE o.name END AS name FROM old o FULL JOIN new n ON o.ticker = n.ticker""")
def merge_keeping_order(spark, sf):
    old = table(spark, sf, "nation").select(F.col("n_nationkey").alias("ticker"), F.col("n_nationkey").alias("place"), F.col("n_name").alias("name"))
    far = (F.col("r_regionkey") + 100).cast("int")
    new = old.where("ticker % 3 = 0").withColumn("name", F.concat(F.lit("new "), F.col("name"))).unionByName(table(spark, sf, "region").select(far.alias("ticker"), far.alias("place"), F.col("r_name").alias("name")))
    return N.merge_in_order(old, new)


@query("""WITH s AS (SELECT s_suppkey::VARCHAR AS key, 'T' || s_nationkey AS ticker, s_suppkey AS place FROM supplier WHERE s_suppkey <= 10), r AS (SELECT c_custkey::VARCHAR AS key, 'T' || c_custkey % 400 AS ticker, c_custkey AS place FROM customer),
a AS (SELECT * FROM r WHERE key NOT IN (SELECT key FROM s) AND ticker NOT IN (SELECT ticker FROM s)), k AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY key ORDER BY place) = 1), t AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY place) = 1) SELECT *, 0 AS origin FROM s UNION ALL SELECT *, 1 FROM t""")
def union_with_starter(spark, sf):
    s = table(spark, sf, "supplier").where("s_suppkey <= 10").select(F.col("s_suppkey").cast("string").alias("key"), F.concat(F.lit("T"), F.col("s_nationkey").cast("string")).alias("ticker"), F.col("s_suppkey").alias("place"))
    r = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.concat(F.lit("T"), (F.col("c_custkey") % 400).cast("string")).alias("ticker"), F.col("c_custkey").alias("place"))
    return N.union_with_starter(s, r)


@query("""WITH p AS (SELECT p_partkey AS ticker, p_size % 3 AS priority, p_size > 48 AS supported FROM part), s AS (SELECT * FROM p WHERE supported ORDER BY priority, ticker LIMIT 100 OFFSET 2) SELECT * FROM s UNION ALL SELECT * FROM (SELECT * FROM p WHERE NOT supported ORDER BY priority, ticker LIMIT greatest(0, 100 - (SELECT count(*) FROM s)))""")
def limit_two_classes(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("ticker"), (F.col("p_size") % 3).alias("priority"), (F.col("p_size") > 48).alias("supported"))
    return N.limit_two_classes(p, N.parse_limit("100"), N.parse_offset("2"))


@query(f"WITH {MESSAGES}, cut AS (SELECT max(event_id) * 99 // 100 AS upto FROM messages), old AS (SELECT user_id::VARCHAR AS ticker, message FROM messages, cut WHERE event_id <= upto), new AS (SELECT user_id::VARCHAR AS ticker, message FROM messages, cut WHERE event_id > upto) SELECT * FROM old WHERE ticker NOT IN (SELECT ticker FROM new) UNION ALL SELECT * FROM new")
def replace_errors(spark, sf):
    m = _messages(spark, sf).withColumn("ticker", F.col("user_id").cast("string"))
    at = F.lit((m.agg(F.max("event_id")).first()[0] or 0) * 99 // 100)
    return N.replace_errors(m.where(F.col("event_id") <= at).select("ticker", "message"), m.where(F.col("event_id") > at).select("ticker", "message"))


@query("SELECT s_suppkey::VARCHAR AS ticker, d IS NOT NULL AS filings_downloaded, d IS NOT NULL AS bm25_indexed, s_acctbal > 0 AS balance_sheet, d AS latest_filing_date FROM supplier LEFT JOIN (SELECT l_suppkey, max(CAST(l_shipdate AS DATE)) AS d FROM lineitem WHERE l_quantity > 49 AND l_suppkey % 2 = 0 GROUP BY 1) ON l_suppkey = s_suppkey")
def index_status(spark, sf):
    flags = F.struct(F.lit(False).alias("filings_downloaded"), F.lit(False).alias("filings_cleaned"), F.lit(False).alias("filings_chunked"), F.lit(True).alias("bm25_indexed"), (F.col("s_acctbal") > 0).alias("balance_sheet"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("ticker"), flags.alias("data_status"))
    i = table(spark, sf, "lineitem").where("l_quantity > 49 and l_suppkey % 2 = 0").groupBy(F.col("l_suppkey").cast("string").alias("ticker")).agg(F.max(F.col("l_shipdate").cast("date")).alias("latest_filing_date"))
    return N.index_status(s, i).select("ticker", "data_status.filings_downloaded", "data_status.bm25_indexed", "data_status.balance_sheet", "latest_filing_date")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'Scored' ELSE 'Insufficient' END || ' · ' || CASE WHEN c_custkey % 2 = 0 THEN 'Searchable' ELSE 'No BM25' END || ' · ' || CASE WHEN c_custkey % 3 = 0 THEN 'Balance sheet full' WHEN c_custkey % 3 = 1 THEN 'Balance sheet partial' ELSE 'No balance sheet' END AS label FROM customer")
def status_labels(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", N.status_label(F.col("c_acctbal") > 0, k % 2 == 0, k % 3 == 0, k % 3 == 1).alias("label"))


@query("""SELECT c_custkey, c_custkey % 11 >= 5 AS inputs_available, level <> 'Insufficient' AS available, 'neutral' AS signal, CASE WHEN level = 'Insufficient' THEN 'Insufficient scoring inputs' END AS reason, true AS traceable FROM (SELECT *, CASE WHEN c_custkey % 11 >= 9 THEN 'High' WHEN c_custkey % 11 >= 7 THEN 'Medium' WHEN c_custkey % 11 >= 5 THEN 'Low' ELSE 'Insufficient' END AS level FROM customer)""")
def signal_status(spark, sf):
    n = F.col("c_custkey") % 11
    level = F.when(n >= 9, "High").when(n >= 7, "Medium").when(n >= 5, "Low").otherwise("Insufficient")
    status = F.struct(F.lit(True).alias("traceable"))
    c = table(spark, sf, "customer").select("c_custkey", N.signal_status(status, n, level, F.lit("neutral"), F.lit("2024-01-01")).alias("s"))
    return c.select("c_custkey", F.col("s.scoring_inputs_available").alias("inputs_available"), F.col("s.scoring_available").alias("available"), F.col("s.official_signal").alias("signal"), F.col("s.insufficient_reason").alias("reason"), "s.traceable")


@query("""WITH e AS (SELECT coalesce(source, 'none') AS ticker, count(*) AS documents, sum(n_chars) AS terms FROM documents GROUP BY 1), l AS (SELECT *, ticker || ':' || documents || '::search/' || ticker AS line FROM e), p AS (SELECT substr(ticker, 1, 2) AS prefix, sha256(string_agg(line, chr(10) ORDER BY line)) AS part, count(*) AS n, sum(documents) AS documents, sum(terms) AS terms FROM l GROUP BY 1)
SELECT sum(n)::BIGINT AS tickers, sum(documents)::BIGINT AS documents, sum(terms)::BIGINT AS terms, sha256(string_agg(part, chr(10) ORDER BY prefix)) AS corpus_hash FROM p""")
def index_manifest(spark, sf):
    e = table(spark, sf, "documents").groupBy(F.coalesce("source", F.lit("none")).alias("ticker")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("terms"))
    return N.manifest_hash(e.withColumn("latest_filing_date", F.lit(None).cast("date")).withColumn("path", F.concat(F.lit("search/"), F.col("ticker"))))


_SUPPORTED = "CASE WHEN c_mktsegment = 'FURNITURE' THEN 'fund' WHEN c_custkey % 17 = 0 THEN 'exchange' END"


@query(f"""WITH u AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'NYSE' WHEN 1 THEN 'Nasdaq' ELSE 'OTC' END AS exchange, {_SUPPORTED} AS why, c_acctbal AS b FROM customer) SELECT count(*) AS raw_symbols, count(DISTINCT c_custkey % 1000) AS unique_ciks, count(*) FILTER (upper(exchange) IN ('NYSE', 'NASDAQ')) AS listed, count(*) FILTER (why IS NULL) AS supported, count(*) FILTER (c_custkey % 2 = 0) AS recent_annual, count(*) FILTER (c_custkey % 5 <> 0) AS recent_quarterly,
 count(*) FILTER (c_custkey % 4 = 0) AS downloaded, count(*) FILTER (c_custkey % 8 = 0) AS indexed, count(*) FILTER (c_custkey % 8 = 0) AS searchable, count(*) FILTER (b > 0) AS companyfacts, count(*) FILTER (b > 1000) AS scoreable, count(*) FILTER (b <= 1000) AS insufficient, count(*) FILTER (why IS NOT NULL) AS unsupported, count(*) FILTER (b < -900) AS failed FROM u""")
def coverage_report(spark, sf):
    k = F.col("c_custkey")
    u = table(spark, sf, "customer").select((k % 1000).alias("cik"), F.when(k % 3 == 0, "NYSE").when(k % 3 == 1, "Nasdaq").otherwise("OTC").alias("exchange"), F.expr(_SUPPORTED).alias("exclude_reason"), (k % 2 == 0).alias("annual"), (k % 5 != 0).alias("quarterly"), (k % 4 == 0).alias("downloaded"), (k % 8 == 0).alias("indexed"),
                                            (F.col("c_acctbal") > 0).alias("companyfacts"), F.when(F.col("c_acctbal") > 1000, "Low").otherwise("Insufficient").alias("confidence"), (F.col("c_acctbal") < -900).alias("failed"))
    return H.coverage(u)


@query(f"WITH u AS (SELECT {_SUPPORTED} AS why, CASE c_custkey % 3 WHEN 0 THEN 'NYSE' WHEN 1 THEN 'Nasdaq' ELSE 'OTC' END AS exchange, c_name FROM customer) SELECT count(*) AS companies, count(*) FILTER (why IS NULL) AS supported, count(*) FILTER (why IS NOT NULL) AS unsupported, (SELECT string_agg(DISTINCT exchange, ',' ORDER BY exchange) FROM u) AS exchanges, (SELECT string_agg(why || ':' || n, ',' ORDER BY why) FROM (SELECT why, count(*) AS n FROM u WHERE why IS NOT NULL GROUP BY why)) AS reasons FROM u")
def universe_manifest(spark, sf):
    k = F.col("c_custkey")
    u = table(spark, sf, "customer").select(F.expr(_SUPPORTED).alias("exclude_reason"), F.when(k % 3 == 0, "NYSE").when(k % 3 == 1, "Nasdaq").otherwise("OTC").alias("exchange"))
    m = u.agg(F.count(F.lit(1)).alias("companies"), F.count_if(F.col("exclude_reason").isNull()).alias("supported"), F.count("exclude_reason").alias("unsupported"), F.array_join(F.array_sort(F.collect_set("exchange")), ",").alias("exchanges"))
    why = u.where("exclude_reason is not null").groupBy("exclude_reason").agg(F.count(F.lit(1)).alias("n")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "exclude_reason", F.col("n").cast("string")))), ",").alias("reasons"))
    return m.join(why, F.lit(True))  # one row each


@query(OBS + """, cohorts AS (SELECT signal, horizon, count(*) AS n FROM obs GROUP BY 1, 2) SELECT count(*) AS observations, count(*) FILTER (signal_day >= entry_day) AS entered_early, count(*) FILTER (entry_day >= outcome_day) AS ended_early, count(*) FILTER (bench_return IS NULL) AS no_benchmark, (SELECT sum(n)::BIGINT FROM cohorts) AS in_cohorts FROM obs""")
def audit_backtest(spark, sf):
    o = written(observations(spark, sf), "observations")
    cohorts = o.groupBy("signal", "horizon").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("in_cohorts"))
    a = o.agg(F.count(F.lit(1)).alias("observations"), F.count_if(F.col("signal_day") >= F.col("entry_day")).alias("entered_early"), F.count_if(F.col("entry_day") >= F.col("outcome_day")).alias("ended_early"), F.count_if(F.col("bench_return").isNull()).alias("no_benchmark"))
    return a.join(cohorts, F.lit(True))  # one row each


@query(f"WITH {FACTS} SELECT entity, bool_or(form = 'F') AS annual, bool_or(form = 'O') AS quarterly, max(filed) AS latest FROM facts GROUP BY entity")
def forms_available(spark, sf):
    return facts(spark, sf).groupBy("entity").agg(F.bool_or(F.col("form") == "F").alias("annual"), F.bool_or(F.col("form") == "O").alias("quarterly"), F.max("filed").alias("latest"))


# ---- readers and writers --------------------------------------------------------------------------------------------


@query(f"WITH {BARS} SELECT ticker, day AS date, open, high, low, close, volume FROM bars")
def scan_price_csv(spark, sf):
    path = fresh_path(spark, "csv")
    bars(spark, sf).select("ticker", F.col("day").alias("date"), "open", "high", "low", "close", "volume").write.option("header", True).csv(path)  # many series a file, one file a task
    return TB.price_csv(spark, path, "ticker bigint")


@query(f"WITH {BARS} SELECT ticker, day AS date, open, high, low, close, volume, adj_close AS adjusted_close FROM bars")
def scan_chart_json(spark, sf):
    path = fresh_path(spark, "charts")
    TB.chart_lines(bars(spark, sf)).write.text(path)
    return TB.chart_bars(TB.charts(spark, path)).withColumn("ticker", F.col("ticker").cast("bigint"))


_CONCEPTS = [("1-URGENT", "Assets"), ("2-HIGH", "Liabilities"), ("3-MEDIUM", "Revenue"), ("5-LOW", "Shares outstanding")]


@query(f"""SELECT o_custkey::VARCHAR AS cik, l.label AS label, CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE o_totalprice END AS value, CAST(o_orderdate AS DATE) AS period_end, CASE o_orderstatus WHEN 'F' THEN '10-K' ELSE '10-Q' END AS form FROM orders JOIN (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _CONCEPTS)}) l(concept, label) ON l.concept = o_orderpriority
 WHERE o_orderstatus IN ('F', 'O') AND NOT (l.label IN ('Assets', 'Shares outstanding') AND o_orderkey % 50 = 0)""")
def scan_company_facts(spark, sf):
    """Payloads of nested maps, written as JSON lines, read with a schema and flattened."""
    o = table(spark, sf, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    value = F.when(F.col("o_orderkey") % 50 == 0, 0.0).otherwise(F.col("o_totalprice"))
    form = F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-Q").otherwise("8-K")
    point = F.struct(value.alias("val"), F.col("day").alias("end"), F.col("day").alias("filed"), F.lit(2000).alias("fy"), F.lit("FY").alias("fp"), form.alias("form"), F.col("o_orderkey").cast("string").alias("accn"))
    units = o.groupBy("o_custkey", "o_orderpriority").agg(F.collect_list(point).alias("points"))
    concept = F.struct(F.col("o_orderpriority").alias("key"), F.struct(F.create_map(F.lit("USD"), F.col("points")).alias("units")).alias("value"))
    whole = units.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(concept)).alias("concepts"))
    path = fresh_path(spark, "facts")
    whole.select(F.to_json(F.struct(F.col("o_custkey").cast("string").alias("cik"), F.create_map(F.lit("us-gaap"), F.col("concepts")).alias("facts"))).alias("value")).write.text(path)
    dictionary = spark.createDataFrame([(a, b, "USD") for a, b in _CONCEPTS], "concept string, label string, unit string")
    return TB.flatten_company_facts(TB.company_facts(spark, path), dictionary).select("cik", "label", "value", "period_end", "form")


@query("""WITH o AS (SELECT o_custkey::VARCHAR AS cik, CASE o_orderstatus WHEN 'F' THEN '10-k' WHEN 'O' THEN '10-Q' ELSE '8-K' END AS form, strftime(o_orderdate, '%Y-%m-%d') AS filed, o_orderkey::VARCHAR AS accession, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS pos FROM orders)
SELECT cik, form, filed, accession FROM o WHERE upper(form) IN ('10-K', '10-Q') AND filed >= '1996-01-01' QUALIFY row_number() OVER (PARTITION BY cik, upper(form) ORDER BY pos) <= 2""")
def recent_filings(spark, sf):
    o = table(spark, sf, "orders")
    row = F.struct(F.col("o_orderkey"), F.when(F.col("o_orderstatus") == "F", "10-k").when(F.col("o_orderstatus") == "O", "10-Q").otherwise("8-K").alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed"))
    g = o.groupBy(F.col("o_custkey").cast("string").alias("cik")).agg(F.sort_array(F.collect_list(row), asc=False).alias("a"))
    s = g.select("cik", F.col("a.form").alias("form"), F.col("a.filed").alias("filingDate"), F.col("a.filed").alias("reportDate"), F.transform("a.o_orderkey", lambda k: k.cast("string")).alias("accessionNumber"), F.col("a.filed").alias("primaryDocument"))
    return TB.recent_filings(s, ["10-K", "10-Q"], 2, "1996-01-01").select("cik", "form", F.col("filingDate").alias("filed"), F.col("accessionNumber").alias("accession"))


@query("SELECT c_custkey::VARCHAR AS cik, replace(upper(trim(c_name)), '.', '-') AS ticker, c_mktsegment AS exchange FROM customer WHERE c_custkey % 3 <> 0 ORDER BY c_nationkey, replace(upper(trim(c_name)), '.', '-') LIMIT 40 OFFSET 10")
def symbol_universe(spark, sf):
    """A symbol map of field names and rows, as a universe of supported companies, one page of it."""
    c = table(spark, sf, "customer").select(F.array(F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 3 == 0, "false")).alias("data"))
    rows = TB.symbol_map(c, ["cik", "ticker", "exchange", "priority", "supported"]).withColumn("priority", F.col("priority").cast("int")).withColumn("isSupported", F.col("supported").cast("boolean"))
    return TB.universe(rows, 40, 10).select("cik", "ticker", "exchange")


@query("WITH r AS (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_linenumber = 3 THEN NULL WHEN l_discount = 0 THEN -1 ELSE l_extendedprice END AS price, l_orderkey AS o, l_linenumber AS n, l_partkey AS p FROM lineitem) SELECT ticker, date, price FROM r WHERE price > 0 QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY o DESC, n DESC, p DESC) = 1")
def price_points_last_wins(spark, sf):
    return TB.normalize_points(_raw_points(spark, sf), ["o", "n", "p"])


def _raw_points(spark, sf) -> DataFrame:
    price = F.when(F.col("l_linenumber") == 3, None).when(F.col("l_discount") == 0, -1.0).otherwise(F.col("l_extendedprice"))
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("date"), price.alias("price"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"))


@query("SELECT l_suppkey AS ticker, count(DISTINCT CAST(l_shipdate AS DATE)) AS kept, count(*) - count(DISTINCT CAST(l_shipdate AS DATE)) AS rejected FROM lineitem GROUP BY 1")
def duplicate_dates_rejected(spark, sf):
    return TB.reject_duplicate_dates(_raw_points(spark, sf), ["o", "n", "p"]).groupBy("ticker").agg(F.count(F.lit(1)).alias("kept"), F.sum("rejected").alias("rejected"))


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY ALL")
def artifact_roundtrip(spark, sf):
    """Tables written by key, one key's replaced, the stale ones' folders removed, and read again."""
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("ticker"), "c_nationkey", "c_custkey")
    path = fresh_path(spark, "by-key")
    sinks.write_by_key(c.withColumn("c_custkey", F.lit(0).cast("bigint")), path)
    sinks.write_by_key(c, path)
    sinks.remove_stale(spark, path, c.where("ticker <> 'BUILDING'"))
    back = spark.read.parquet(path)
    return back.groupBy("c_nationkey", F.col("ticker").alias("c_mktsegment")).agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


@query("WITH p AS (SELECT c_custkey AS k, c_acctbal + 1 AS v, CASE WHEN c_custkey % 10 = 0 THEN 'new' END AS note FROM customer WHERE c_custkey % 5 = 0) SELECT c_custkey AS k, coalesce(p.v, c_acctbal) AS v, coalesce(p.note, c_mktsegment) AS note FROM customer LEFT JOIN p ON p.k = c_custkey WHERE c_custkey % 7 <> 0")
def update_and_delete(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("note"))
    patch = c.where("k % 5 = 0").select("k", (F.col("v") + 1).alias("v"), F.when(F.col("k") % 10 == 0, "new").alias("note"))
    return sinks.delete_rows(sinks.update_rows(c, patch, ["k"], ["v", "note"]), c.where("k % 7 = 0"), ["k"])


@query("SELECT k, n, tag FROM (SELECT k, count(*) AS n, 'except' AS tag FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) GROUP BY k UNION ALL SELECT k, count(*), 'intersect' FROM (SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier) GROUP BY k)")
def bag_set_ops(spark, sf):
    c, s = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    count = lambda df, tag: df.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("tag", F.lit(tag))
    return count(c.exceptAll(s), "except").unionByName(count(c.intersectAll(s), "intersect"))


@query("SELECT s_suppkey, CASE WHEN d IS NULL THEN 'none' ELSE 'there' END AS state FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey AS d FROM lineitem WHERE l_suppkey % 2 = 0) ON d = s_suppkey")
def artifact_fallback(spark, sf):
    """Two artifacts, one of which isn't there: its reader gives no rows, not an error."""
    path = fresh_path(spark, "artifact")
    sinks.write_table(table(spark, sf, "lineitem").where("l_suppkey % 2 = 0").select(F.col("l_suppkey").alias("s_suppkey")).distinct(), path)
    there, none = TB.or_empty(spark, path, "s_suppkey bigint"), TB.or_empty(spark, path + "-other", "s_suppkey bigint")
    marked = there.unionByName(none).withColumn("state", F.lit("there"))
    return table(spark, sf, "supplier").select("s_suppkey").join(marked, "s_suppkey", "left").select("s_suppkey", F.coalesce("state", F.lit("none")).alias("state"))
