"""The analytics tables, derived from the stored ones; each with the DuckDB text of the same definition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspike.functions.exprs import rounded
from marlspike.sources.tables import table


#: Lines of each task that makes series of them.
LINES = 200_000


def _dealt(lines: DataFrame, key: str) -> DataFrame:
    """``lines`` by series in as many partitions as their number asks for: what follows a series needs no other shuffle, and no task grows with the table."""
    return lines.repartition(max(1, -(-lines.count() // LINES)), key)


def _series(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Daily log return (half the mean discount's distance from 5 percent, exact to 8 digits) and volume."""
    mean = F.sum(F.col("l_discount").cast("decimal(18,6)")).cast("double") / F.count(F.lit(1))
    daily = lines.select(*keys, F.col("l_shipdate").cast("date").alias("day"), "l_discount", "l_quantity")
    return daily.groupBy(*keys, "day").agg(rounded(0.5 * (mean - 0.05), 8).cast("decimal(18,8)").alias("lr"), F.sum("l_quantity").cast("bigint").alias("volume"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, day, idx, n, open, high, low, close, adj_close, price, volume): one series per supplier."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ticker"), "l_shipdate", "l_discount", "l_quantity")
    lines = _dealt(lines, "ticker")
    w = Window.partitionBy("ticker").orderBy("day")
    out = _series(lines, ["ticker"]).withColumn("idx", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("ticker")))
    out = out.withColumn("close", F.round(100 * F.exp(F.sum("lr").over(w).cast("double")), 6)).withColumn("open", F.coalesce(F.lag("close").over(w), F.col("close")))
    out = out.withColumn("high", F.greatest("open", "close")).withColumn("low", F.least("open", "close"))
    out = out.withColumn("adj_close", F.when(F.col("idx") % 7 != 0, F.col("close"))).withColumn("price", F.coalesce("adj_close", "close"))
    return out.select("ticker", "day", "idx", "n", "open", "high", "low", "close", "adj_close", "price", "volume")


def benchmark_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, idx, price) of all suppliers together."""
    return _index(table(spark, sf_dir, "lineitem"))


def exchange_bars(spark: SparkSession, sf_dir: str, exchange: str) -> DataFrame:
    """(day, idx, price) of the suppliers of one exchange."""
    there = securities(spark, sf_dir).where(F.col("exchange") == exchange).select(F.col("ticker").alias("l_suppkey"))
    return _index(table(spark, sf_dir, "lineitem").join(there, "l_suppkey", "left_semi"))


def _index(lines: DataFrame) -> DataFrame:
    lines = lines.withColumn("ticker", F.lit(0))
    w = Window.partitionBy("ticker").orderBy("day")
    out = _series(lines, ["ticker"])
    return out.select("day", (F.row_number().over(w) - 1).alias("idx"), F.round(100 * F.exp(F.sum("lr").over(w).cast("double")), 6).alias("price"))


BARS = """lr AS (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS day,
  CAST(round(0.5 * (CAST(sum(CAST(l_discount AS DECIMAL(18,6))) AS DOUBLE) / count(*) - 0.05), 8) AS DECIMAL(18,8)) AS lr, CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM lineitem GROUP BY 1, 2),
b0 AS (SELECT *, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY ticker) AS n, round(100 * exp(CAST(sum(lr) OVER w AS DOUBLE)), 6) AS close FROM lr WINDOW w AS (PARTITION BY ticker ORDER BY day)),
b1 AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY ticker ORDER BY day), close) AS open FROM b0),
bars AS MATERIALIZED (SELECT ticker, day, idx, n, open, greatest(open, close) AS high, least(open, close) AS low, close, CASE WHEN idx % 7 <> 0 THEN close END AS adj_close, close AS price, volume FROM b1)"""

BENCH = """blr AS (SELECT CAST(l_shipdate AS DATE) AS day, CAST(round(0.5 * (CAST(sum(CAST(l_discount AS DECIMAL(18,6))) AS DOUBLE) / count(*) - 0.05), 8) AS DECIMAL(18,8)) AS lr FROM lineitem GROUP BY 1),
bench AS MATERIALIZED (SELECT day, row_number() OVER (ORDER BY day) - 1 AS idx, round(100 * exp(CAST(sum(lr) OVER (ORDER BY day) AS DOUBLE)), 6) AS price FROM blr)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, label, value, form, period_end, filed, accession): one bitemporal fact per order."""
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    return o.select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("label"), F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("form"), day.alias("period_end"), F.date_add(day, (F.col("o_orderkey") % 60).cast("int")).alias("filed"), F.col("o_orderkey").alias("accession"))


FACTS = """facts AS (SELECT o_custkey AS entity, o_orderpriority AS label, o_totalprice AS value, o_orderstatus AS form, CAST(o_orderdate AS DATE) AS period_end,
  CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INT) AS filed, o_orderkey AS accession FROM orders)"""


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, sector, exchange, balance) of each supplier."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    n = n.join(r, n.n_regionkey == r.r_regionkey, "left")
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").select(F.col("s_suppkey").alias("ticker"), F.col("n_name").alias("sector"), F.col("r_name").alias("exchange"), F.col("s_acctbal").alias("balance"))


SECURITIES = """securities AS (SELECT s_suppkey AS ticker, n_name AS sector, r_name AS exchange, s_acctbal AS balance FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ticker, form, text): documents as filings."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("ticker"), F.col("lang").alias("form"), "text")
