"""Queries of the pipeline's audits and of the application: screens, access, positions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlspike.functions.exprs import codes, money
from marlspike.operators.ranks import row_number, slot_of
from marlspike.operators.scoring import WEIGHTS, contributions
from marlspike.sources.tables import table

from .domain import BARS, SECURITIES, bars, securities
from .fact_queries import CONTRIBUTIONS, _scored
from .registry import query


@query("SELECT c_custkey, CAST(((row_number() OVER (ORDER BY c_custkey) - 1 - 37) % count(*) OVER () + count(*) OVER ()) % count(*) OVER () AS BIGINT) AS slot FROM customer")
def ring_cursor(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    return row_number(c, "c_custkey", "place").select("c_custkey", slot_of("place", 37, c.count()).cast("bigint").alias("slot"))


@query(f"WITH {BARS} SELECT ticker, count(*) - count(DISTINCT day) AS duplicates, count(*) FILTER (price <= 0) AS not_positive, count(*) FILTER (high < low) AS crossed FROM bars GROUP BY ticker")
def audit_price_order(spark, sf):
    return bars(spark, sf).groupBy("ticker").agg((F.count(F.lit(1)) - F.countDistinct("day")).alias("duplicates"), F.count_if(F.col("price") <= 0).alias("not_positive"), F.count_if(F.col("high") < F.col("low")).alias("crossed"))


@query(CONTRIBUTIONS + " SELECT component, count(*) AS checked, count(*) FILTER (abs(points - score) > 0.001) AS wrong, count(*) FILTER (score NOT BETWEEN 0 AND 100) AS out_of_bounds FROM (SELECT ticker, component, sum(points) AS points FROM contributions GROUP BY 1, 2) JOIN (" + " UNION ALL ".join(f"SELECT ticker, '{c}' AS component, {c} AS score FROM scored" for c in WEIGHTS) + ") USING (ticker, component) GROUP BY component")
def audit_contributions(spark, sf):
    """Points of each component against its score."""
    s = _scored(spark, sf).withColumn("parts", contributions())
    points = F.aggregate(F.filter("parts", lambda p: p["component"] == F.col("component")), F.lit(0.0), lambda a, p: a + p["points"])
    s = s.select("ticker", "parts", F.inline(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("score")) for c in WEIGHTS]))).where("score is not null")
    s = s.withColumn("points", points)
    return s.groupBy("component").agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.abs(F.col("points") - F.col("score")) > 0.001).alias("wrong"), F.count_if(~F.col("score").between(0, 100)).alias("out_of_bounds"))


@query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'a') AND p_size > 5 ORDER BY coalesce(p_retailprice, -1) DESC, p_partkey LIMIT 50 OFFSET 50")
def screen_filter_sort_page(spark, sf):
    p = table(spark, sf, "part").where(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")).contains("a") & (F.col("p_size") > 5))
    return p.orderBy(F.coalesce("p_retailprice", F.lit(-1.0)).desc(), "p_partkey").offset(50).limit(50).select("p_partkey", "p_name", "p_retailprice")


@query(f"WITH {SECURITIES} SELECT exchange, round(median(balance), 1) AS median_balance, count(*) FILTER (balance > 5000) AS strong, count(*) AS n FROM securities GROUP BY exchange")
def dashboard_kpis(spark, sf):
    return securities(spark, sf).groupBy("exchange").agg(F.round(F.median("balance"), 1).alias("median_balance"), F.count_if(F.col("balance") > 5000).alias("strong"), F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, round(pow(1 + p_size / 100.0::DOUBLE, 30.0::DOUBLE / 365) - 1, 6) AS scaled FROM part")
def target_scaling(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(F.pow(1 + F.col("p_size") / 100.0, F.lit(30.0 / 365)) - 1, 6).alias("scaled"))


@query(f"WITH {SECURITIES} SELECT ticker, array_to_string(list_filter([CASE WHEN balance > 5000 THEN 'strong balance' END, CASE WHEN balance < 0 THEN 'negative balance' END, sector], lambda x: x IS NOT NULL), '; ') AS claims FROM securities")
def brief_claims(spark, sf):
    return securities(spark, sf).select("ticker", F.concat_ws("; ", F.when(F.col("balance") > 5000, "strong balance"), F.when(F.col("balance") < 0, "negative balance"), "sector").alias("claims"))
