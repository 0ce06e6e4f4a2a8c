"""Universe modes, the screen and briefs on small rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marlspike.operators import brief as A
from marlspike.operators import scoring as S
from marlspike.operators import screen as V
from marlspike.operators import universe as U


def records(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "cik string, ticker string, name string, exchange string, place long")


def test_modes_need_what_they_read(spark):
    assert [r["ticker"] for r in U.build(spark, "starter", limit=3).orderBy("place").collect()] == ["AAPL", "MSFT", "GOOGL"]
    with pytest.raises(ValueError):
        U.build(spark, "nyse")
    with pytest.raises(ValueError):
        U.build(spark, "everything", records(spark, [("1", "A", "A", "NYSE")]))


def test_duplicates_stay_marked_and_fill_up(spark):
    r = records(spark, [("1", "bb", "B", "nyse"), ("1", "BB", "B", "NYSE"), ("2", "AA", "A", "NYSE"), ("3", "CC", "C Fund", "NYSE"), ("4", "DD", "D", "OTC")])
    rows = {x["place"]: x for x in U.build(spark, "sec_listed_all", r).collect()}
    assert [rows[i]["exclude_reason"] for i in range(5)] == [None, "duplicate", None, "fund", "exchange"]
    got = [(x["ticker"], x["supported"]) for x in U.build(spark, "nyse", r, limit=3).collect()]
    assert sorted(got) == [("AA", True), ("BB", False), ("BB", True)]  # of the others the one of the best priority
    assert [x["ticker"] for x in U.build(spark, "nyse", r, offset=1).where("supported").collect()] == ["BB"]


def test_starter_takes_no_place(spark):
    r = records(spark, [("9", "AAPL", "Other", "NASDAQ"), ("8", "ZZ", "Z", "NASDAQ"), ("7", "ZZ", "Z", "NASDAQ"), ("6", "YY", "Y", "NASDAQ")])
    got = U.build(spark, "nasdaq", r, limit=12, include_starter=True).collect()
    assert sorted(x["ticker"] for x in got if x["origin"] == 1) == ["YY", "ZZ"] and len(got) == 12
    assert [x["place"] for x in got if x["ticker"] == "ZZ"] == [1]
    assert U.build(spark, "nasdaq", r.limit(0), include_starter=True).count() == len(U.SEED)


def board(spark):
    rows = [("A", "Alpha", "Tech", 10.0, "High", 5.0), ("B", "Beta", None, None, "Low", 7.0), ("C", "Gamma", "Tech", 10.0, "Insufficient", 1.0), ("D", "Delta", "Food", 99.0, "Medium", 2.0)]
    return spark.createDataFrame(rows, "ticker string, name string, sector string, value double, confidence string, price double")


def order(found):
    return [r["ticker"] for r in found[0].orderBy("place").collect()]


def test_screen_sorts_and_clamps(spark):
    b = board(spark)
    assert order(V.page(b, "value")) == ["B", "A", "C", "D"] and order(V.page(b, "value", True)) == ["D", "A", "C", "B"]
    assert order(V.page(b, "confidence", True)) == ["A", "D", "B", "C"] and order(V.page(b, "price")) == ["C", "D", "A", "B"]
    found = V.page(b, number=9, size=3)
    assert order(found) == ["D"] and found[1:] == (2, 2) and V.page(b.limit(0), number=4)[1:] == (1, 1)
    assert [r["place"] for r in found[0].collect()] == [4]
    assert order(V.page(V.matching(b, " TECH "))) == ["A", "C"] and order(V.page(V.matching(b, confidence="Low"))) == ["B"]
    with pytest.raises(ValueError):
        V.page(b, "size")


def scored(spark, evidence=False):
    rows = spark.createDataFrame([("T1", "value-trap-risk", "High", 80.04, 50.0, None, 20.0, 70.0), ("T2", None, None, None, None, None, None, None)], "ticker string, signal string, confidence string, value double, quality double, momentum double, market_risk double, balance_risk double")
    if evidence:
        one = lambda k: F.struct(F.lit("10-K").alias("form"), F.lit("1A").alias("item"), F.lit("2024-02-01").alias("filed"), F.lit(f"text {k}").alias("text"), F.lit(f"u{k}").alias("url"))
        rows = rows.withColumn("evidence", F.array(*[one(k) for k in range(5)]))
    return rows


def test_brief_states_facts_and_gaps(spark):
    cohorts = spark.createDataFrame([("value-trap-risk", 12, -0.0312, 0.25)], "signal string, n long, mean_excess double, win_rate double")
    got = {r["ticker"]: r for r in A.briefs(scored(spark), cohorts).withColumn("markdown", A.markdown()).collect()}
    one, two = got["T1"], got["T2"]
    assert [c["id"] for c in one["claims"]] == ["signal", "score-value", "score-quality", "score-market_risk", "score-balance_risk", "backtest-90"]
    assert one["claims"][0]["text"] == "The current rules classify T1 as value trap risk with high confidence." and one["claims"][1]["text"] == "Value: 80.0 out of 100."
    assert "12 observations, with mean excess return -3.1% and win rate 25.0%" in one["backtest_context"]
    assert one["missing"] == ["Momentum score is unavailable.", A.NO_EVIDENCE] and len(one["questions"]) == 3
    assert two["template_id"] == "insufficient-evidence" and two["claims"] == [] and two["missing"] == [A.NO_SIGNAL, A.NO_BACKTEST, A.NO_EVIDENCE]
    assert one["markdown"].startswith("# T1: Apparent value with a material risk flag\n\n") and one["markdown"].endswith("\n\n" + A.DISCLAIMER)


def test_brief_cites_three_passages(spark):
    one = A.briefs(scored(spark, True), None).withColumn("markdown", A.markdown()).where("ticker = 'T1'").first()
    assert len(one["evidence"]) == 3 and A.NO_BACKTEST in one["missing"] and A.NO_EVIDENCE not in one["missing"]
    assert "- 10-K 1A, filed 2024-02-01: “text 2” [SEC citation](u2)" in one["markdown"] and "text 3" not in one["markdown"]


def test_ratios_of_price_only_with_its_columns(spark):
    names = ["assets", "current_assets", "cash", "investments", "receivables", "goodwill", "intangibles", "liabilities", "current_liabilities", "short_debt", "long_debt", "equity", "retained_earnings"]
    b = spark.range(1).select(*[F.lit(10.0).alias(n) for n in names])
    assert "price_to_book" not in S.ratios(b).columns
    row = S.ratios(b.withColumns({"shares": F.lit(4.0), "market_cap": F.lit(25.0)})).first()
    assert (row["book_value_per_share"], row["price_to_book"]) == (2.5, 2.5)
    assert S.ratios(b.withColumns({"shares": F.lit(0.0), "market_cap": F.lit(25.0), "equity": F.lit(-1.0)})).select("book_value_per_share", "price_to_book").first() == (None, None)
