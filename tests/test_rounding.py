"""Results on halves and word ends, as the queries' SQL has them."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from marlspike.functions.exprs import rounded
from marlspike.operators import answers as A
from marlspike.operators import scoring as S
from marlspike.plans import catalogue


def test_halves_round_as_in_sql(spark):
    values = [(x / 1000 + s, d) for x in range(1, 3000, 7) for s in (0.0, 0.005) for d in (1, 2)] + [(-2.675, 2), (-0.5, 1), (float(10**12) + 0.125, 2)]
    got = [r["x"] for d in (1, 2) for r in spark.createDataFrame([(v,) for v, e in values if e == d], "v double").select(rounded("v", d).alias("x")).collect()]
    con = duckdb.connect()
    assert got == [con.execute("select round(?::double, ?)", [v, d]).fetchone()[0] for d in (1, 2) for v, e in values if e == d]


@pytest.mark.parametrize("name", ["position_values", "position_outcomes"])
def test_positions_on_halves(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute("create table customer as select (i * 10 + k)::bigint as c_custkey, (i * 100 + 50) / 100.0::double as c_acctbal from range(0, 9000, 13) r(i), (values (2), (6), (8)) v(k)")
    con.execute(f"copy customer to '{tmp_path}/customer.parquet' (format parquet)")
    df = catalogue.queries()[name](spark, str(tmp_path))
    rel = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, rel.fetchall()))


def test_scores_on_halves(spark):
    """Percentiles of six digits make sums that end in a five; the SQL rounds the scaled double."""
    rows = [(i, (i * 7919 % 100000) / 1e5, (i * 104729 % 100000) / 1e5 + 5e-6) for i in range(3000)]
    df = spark.createDataFrame(rows, "ticker long, p_earnings_yield double, p_sales_yield double")
    got = {r["ticker"]: r["v"] for r in df.select("ticker", S.component("value").alias("v")).collect()}
    con = duckdb.connect()
    want = {i: con.execute("select round(greatest(0, least(100, (?::double * 0.6::double + ?::double * 0.4::double) / (0.6::double + 0.4::double) * 100)), 4)", [a, b]).fetchone()[0] for i, a, b in rows}
    assert got == want


def test_withheld_words_end_as_in_sql(spark):
    texts = ["hold", "éhold", "holdü", "über buy,", "buyer", "_sell", "seſsell", "aſell", "ſell", "this stocK will go up", "HOLD it", "hold́", "x hold\n", "threshold"]
    got = [r["b"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").rlike(A.PROHIBITED).alias("b")).collect()]
    con = duckdb.connect()
    sql = r"(?i)\b(buy|sell|hold|guaranteed upside|this stock will go (?:up|down))\b"
    assert got == [con.execute("select regexp_matches(?, ?)", [t, sql]).fetchone()[0] for t in texts]


def test_small_losses_keep_their_sign(spark):
    """A mean just below zero is shown as -0.0, as printf shows the SQL's negative zero."""
    from marlspike.operators import brief as B

    rows = spark.createDataFrame([(1, "neutral", "High", 50.0, 50.0, 50.0, 50.0, 50.0)], "ticker long, signal string, confidence string, value double, quality double, momentum double, market_risk double, balance_risk double")
    shown = {}
    for mean in (-0.0003, 0.0003, -0.0125, 0.0235):
        cohorts = spark.createDataFrame([("neutral", 9, mean, 0.5)], "signal string, n long, mean_excess double, win_rate double")
        text = B.briefs(rows, cohorts).first()["backtest_context"]
        shown[mean] = text.split("return ")[1].split("%")[0]
    con = duckdb.connect()
    sql = "select case when ?::double >= 0 then '+' else '' end || printf('%.1f', round(?::double * 100, 1))"
    assert shown == {m: con.execute(sql, [m, m]).fetchone()[0] for m in shown} and shown[-0.0003] == "-0.0"
