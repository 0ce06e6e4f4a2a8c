"""Queries of the filing ingest and of merged artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlspike.operators import ingest as IG
from marlspike.sources.scratch import fresh_path
from marlspike.sources.tables import table

from .filing_queries import _LINES, _filings
from .registry import query


@query(f"WITH {_LINES}, ok AS (SELECT DISTINCT accession FROM secs), s AS (SELECT accession, ticker, CASE WHEN accession::BIGINT % 20 = 4 THEN 'EMPTY_DOCUMENT' WHEN NOT regexp_matches(text, '[^ \t\r\f\n]') THEN 'NO_TEXT' WHEN ok.accession IS NULL THEN 'NO_CHUNKS' END AS error, accession::BIGINT % 4 = 1 AS late FROM f LEFT JOIN ok USING (accession)) SELECT accession, ticker, CASE WHEN error IS NULL THEN 'complete' ELSE 'failed' END AS status, CASE error WHEN 'EMPTY_DOCUMENT' THEN 'RAW' WHEN 'NO_TEXT' THEN 'CLEAN' ELSE 'CHUNK' END AS stage, error, late::INT AS run FROM s")
def ingest_status(spark, sf):
    """Where each filing stands after two runs: a quarter came in the first without a body and is taken up again, all others by one run only."""
    f, path = _filings(spark, sf), fresh_path(spark, "ingest")
    n = F.col("accession").cast("long")
    html = F.when(n % 20 != 4, F.concat(F.lit("<p>"), F.regexp_replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), "\n", "</p><p>"), F.lit("</p>")))
    f = f.select("accession", "ticker", "form", html.alias("html"))
    IG.ingest(spark, path, f.withColumn("html", F.when(n % 4 != 1, F.col("html"))))
    IG.ingest(spark, path, f)
    return IG.state(spark, path).select("accession", "ticker", "status", "stage", "error", "run")


@query("""WITH a AS (SELECT unnest(['dashboard', 'features', 'signals']) AS artifact, s_suppkey AS ticker, s_acctbal AS balance FROM supplier), r AS (SELECT l_suppkey AS ticker, round(avg(l_discount), 6) AS score FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1)
SELECT artifact, a.ticker, round(balance, 2) AS balance, CASE WHEN r.ticker IS NULL THEN 'not_detected' WHEN score > 0.05 THEN 'detected' ELSE 'emerging' END AS status, CASE WHEN r.ticker IS NULL THEN -1 ELSE score END AS score FROM a LEFT JOIN r USING (ticker) WHERE NOT (artifact = 'signals' AND a.ticker % 2 = 0)""")
def trend_merge(spark, sf):
    """A third of the tickers' trends computed again and put into three artifacts in one pass."""
    s = table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "ticker")
    old = F.struct(F.lit("not_detected").alias("status"), F.lit(-1.0).alias("score"))
    stored = s.select("ticker", F.struct(F.col("s_acctbal").alias("balance"), old.alias("trend")).alias("record"))
    lines = table(spark, sf, "lineitem").where("l_suppkey % 3 = 0").groupBy(F.col("l_suppkey").alias("ticker")).agg(F.round(F.avg("l_discount"), 6).alias("score"))
    new = lines.select("ticker", F.struct(F.when(F.col("score") > 0.05, "detected").otherwise("emerging").alias("status"), "score").alias("value"))
    merged = IG.merge_nested({"dashboard": stored, "features": stored, "signals": stored.where("ticker % 2 = 1")}, new, "trend")
    return merged.select("artifact", "ticker", F.round("record.balance", 2).alias("balance"), "record.trend.status", "record.trend.score")
