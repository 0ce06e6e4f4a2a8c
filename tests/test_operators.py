"""Exact cases of the analytics operators."""

from __future__ import annotations

import datetime as dt
import math
import re

import pytest
from pyspark.sql import functions as F

from marlspike.functions import exprs as X
from marlspike.operators import forecast as FC
from marlspike.operators import prices as P
from marlspike.operators import scoring as S
from marlspike.operators import search as R
from marlspike.operators import trend as T
from marlspike.sources import sinks
from marlspike.sources import tables as TB


def series(spark, prices, ticker=1):
    day = dt.date(2024, 1, 1)
    rows = [(ticker, day + dt.timedelta(i), i, len(prices), float(p), 1000) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, "ticker long, day date, idx int, n int, price double, volume long")


def test_ramp_returns_and_drawdown(spark):
    b = series(spark, range(100, 200))
    r = b.select("idx", P.n_return(30).alias("a"), P.n_return(90).alias("b")).where("idx = 99").first()
    assert r["a"] == pytest.approx(199 / 169 - 1) and r["b"] == pytest.approx(199 / 109 - 1)
    assert P.drawdown_last(b, 252).first()["drawdown"] == 0


def test_component_renormalises(spark):
    names = list(S.BOUNDS)
    row = spark.createDataFrame([tuple(0.8 if n == "earnings_yield" else None for n in names)], ", ".join(f"p_{n} double" for n in names))
    r = row.select(S.component("value").alias("v"), S.coverage("value").alias("c"), S.component("quality").alias("q")).first()
    assert (r["v"], r["c"], r["q"]) == (80.0, 0.6, None)


def test_balance_ratios_and_negative_equity(spark):
    cols = "assets double, current_assets double, cash double, investments double, receivables double, goodwill double, intangibles double, liabilities double, current_liabilities double, short_debt double, long_debt double, equity double, retained_earnings double"
    rows = [(1000.0, 300.0, 100.0, 20.0, 50.0, 50.0, None, 400.0, 100.0, 20.0, 100.0, 600.0, 200.0), (1000.0, 50.0, 10.0, None, None, 50.0, None, 1200.0, 100.0, 80.0, 900.0, -200.0, -5.0)]
    a, b = S.balance_scores(S.ratios(spark.createDataFrame(rows, cols))).orderBy(F.desc("equity")).collect()
    assert a["current_ratio"] == 3 and a["debt_to_assets"] == 0.12 and not a["g_negative_equity"]
    assert b["g_negative_equity"] and b["s_solvency"] <= 15 and b["balance_penalty"] >= 70 and b["debt_to_equity"] is None


def test_trend_smooth_and_flat(spark):
    b = series(spark, [100 * 1.003**i for i in range(130)]).unionByName(series(spark, [100.0] * 130, 2))
    win = T.windows(b, b.where("idx = n - 1").select("ticker", F.col("idx").alias("e"))).withColumns({"bench21": F.lit(0.0), "bench63": F.lit(0.0), "bench_known": F.lit(130)})
    up, flat = T.scores(T.metrics(win)).orderBy("ticker").collect()
    assert up["status"] == "detected" and up["slope63"] == pytest.approx(math.log(1.003), abs=1e-8) and up["r2_63"] == 1
    assert flat["status"] == "not_detected" and flat["return63"] == 0


def test_calendar_target(spark):
    days = [dt.date(2024, 1, 2), dt.date(2024, 1, 20), dt.date(2024, 2, 2)]
    b = spark.createDataFrame([(1, d, i, 3, p) for i, (d, p) in enumerate(zip(days, [100.0, 110.0, 121.0]))], "ticker int, day date, idx int, n int, price double")
    got = [r["t"] for r in b.select("day", P.target_after(30).alias("t")).orderBy("day").collect()]
    assert got[0] == pytest.approx(math.log(1.21)) and got[1] is None and got[2] is None


def test_asof_takes_the_latest_known(spark):
    left = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 5),), (dt.date(2024, 3, 9),)], "day date")
    right = spark.createDataFrame([(dt.date(2024, 1, 2), 1.0), (dt.date(2024, 1, 5), 2.0)], "day date, price double")
    assert [r["asof"] for r in P.asof_backward(left, right).orderBy("day").collect()] == [None, 2.0, 2.0]


def test_scenario_cap_and_too_few(spark):
    many = spark.createDataFrame([(1, 100.0, 0.5)] * 30 + [(2, 100.0, 0.1)] * 2, "ticker int, current double, r double")
    a, b = FC.scenario(many, 30).orderBy("ticker").collect()
    assert (a["base_return"], a["price"], a["status"]) == (0.08, 108.0, "available") and (b["base_return"], b["status"]) == (None, "insufficient_data")


def test_symbols_and_stems(spark):
    r = spark.createDataFrame([("CIK 320193", " brk.b ", "con")], "a string, b string, c string").select(X.normalize_cik("a"), X.normalize_ticker("b"), X.artifact_stem("c"), X.ticker_of_stem(X.artifact_stem("c"))).first()
    assert tuple(r) == ("0000320193", "BRK-B", "_CON", "CON")


def test_bm25_repeated_terms_and_filter(spark):
    docs = spark.createDataFrame([(1, "a", "en", "debt risk debt"), (2, "b", "en", "cash flow"), (3, "c", "de", "risk")], "doc_id long, ticker string, form string, text string")
    one = spark.createDataFrame([(1, "debt"), (2, "debt debt")], "query_id long, query string")
    got = {r["query_id"]: r["score"] for r in R.bm25(docs, one).collect()}
    assert got[2] == pytest.approx(2 * got[1], abs=1e-4)
    assert [r["doc_id"] for r in R.bm25(docs, spark.createDataFrame([(1, "risk")], "query_id long, query string"), keep=F.col("form") == "de").collect()] == [3]


def test_diversify_prefers_new_sections(spark):
    rows = [(1, 1, 10.0, "s", "alpha beta"), (1, 2, 9.0, "s", "gamma delta"), (1, 3, 8.0, "t", "eps zeta"), (1, 4, 7.0, "u", "alpha beta")]
    got = R.diversify(spark.createDataFrame(rows, "query_id long, doc_id long, score double, section string, text string"), 3).orderBy("place").collect()
    assert [r["doc_id"] for r in got] == [1, 3, 2]


def test_chart_and_company_facts(spark):
    c = spark.createDataFrame([("A", [0, 86400], [1.0, None], [1.0, 2.0], [1.0, 2.0], [1.0, 2.0], [5, 6], [None, 2.0])], TB.CHART)
    assert [(r["date"], r["adjusted_close"]) for r in TB.chart_bars(c).collect()] == [(dt.date(1970, 1, 1), None)]
    point = lambda v, form: {"val": v, "end": "2024-12-31", "filed": "2025-02-01", "fy": 2024, "fp": "FY", "form": form, "accn": "x"}
    facts = {"us-gaap": {"Assets": {"units": {"USD": [point(5.0, "10-K"), point(0.0, "10-K"), point(9.0, "8-K")]}}}}
    d = spark.createDataFrame([("Assets", "Assets", "USD")], "concept string, label string, unit string")
    assert [r["value"] for r in TB.flatten_company_facts(spark.createDataFrame([("1", facts)], TB.COMPANY_FACTS), d).collect()] == [5.0]


def test_upsert_and_insert(spark):
    old, new = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, note string"), spark.createDataFrame([(2, "c", None), (3, "d", None)], "k int, v string, note string")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"], ["note"]).collect())) == [(1, "a", "x"), (2, "c", "y"), (3, "d", None)]
    assert [r["k"] for r in sinks.insert_if_absent(old, new, ["k"]).collect()] == [3]


def test_searches_ask_every_row(spark, sf_dir):
    from marlspike.plans import catalogue

    got = lambda name, key: {r[0] for r in catalogue.queries()[name](spark, sf_dir).select(key).distinct().collect()}
    ids = lambda t, key: {r[0] for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(key).collect()}
    items, vectors = ids("benchmark", "item_id"), {v for v in ids("embeddings", "vec_id") if v % 100 == 0}
    assert all(got(name, "query_id") == items for name in ("bm25_topk", "minmax_normalize", "precision_mrr", "diversify_topk"))
    assert got("cosine_topk", "query_id") == vectors and got("hybrid_fuse", "query_id") == vectors | items


def test_price_rows_are_not_thinned(spark, sf_dir):
    from marlspike.plans import catalogue
    from marlspike.plans.domain import bars

    q, every = catalogue.queries(), bars(spark, sf_dir).select("ticker", "day")
    assert q["rolling_drawdown_63"](spark, sf_dir).count() == every.count()
    assert q["exact_benchmark_align"](spark, sf_dir).join(every, ["ticker", "day"], "left_semi").count() == every.count()
    dates = q["pit_snapshot_join"](spark, sf_dir).select("ticker", "day")
    assert dates.count() > 0 and dates.subtract(q["systematic_sample"](spark, sf_dir).select("ticker", "day")).count() == 0


def test_trend_filter_plans_quickly(spark, sf_dir):
    """A filter on the status is planned on plain columns, not on what they are made of."""
    import time

    from marlspike.plans import price_queries as Q

    rows = Q._trend(spark, sf_dir, True).where("status = 'detected'")
    began = time.time()
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert time.time() - began < 10 and len(plan) < 200_000


def test_plans_of_slow_operators(spark, sf_dir):
    """No join of the bars with themselves in event studies, no window over a whole table, growing frames for forward targets."""
    from marlspike.plans import catalogue, forecast_queries, price_queries

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(price_queries._events(spark, sf_dir, (30, 60, 90))).count("Join") == 0
    assert not re.search(r"RangeFrame, \d+, unboundedfollowing", plan(forecast_queries._rows(spark, sf_dir)), re.I)
    ranks = plan(catalogue.queries()["avg_rank_percentile"](spark, sf_dir))
    assert "_split" in ranks and not re.search(r"Window \[rank\(.*\], \[feature#\d+\], ", ranks)
    assert "LeftSemi" in plan(catalogue.queries()["bm25_topk"](spark, sf_dir))  # terms are filtered before their counts are shuffled


def test_ranks_against_brute_force(spark):
    import random

    from marlspike.operators import ranks

    rng = random.Random(3)
    rows = [(g, rng.choice([None, rng.randint(0, 30), rng.random() * 1e6]), i) for i, g in enumerate("aab" * 400)]
    rows = [(g, None if v is None else float(v), i) for g, v, i in rows] + [("c", 5.0, 9999), ("d", None, 9998)]
    got = {r["i"]: r["pct"] for r in ranks.average_rank(spark.createDataFrame(rows, "g string, v double, i int"), "v", ["g"], "pct", 9).collect()}
    for g in "abcd":
        own = [(v, i) for h, v, i in rows if h == g and v is not None]
        for v, i in own:
            below, equal = sum(x < v for x, _ in own), sum(x == v for x, _ in own)
            assert got[i] == pytest.approx(0.5 if len(own) == 1 else (below + (equal - 1) / 2) / (len(own) - 1), abs=1e-8)
    assert all(got[i] is None for _, v, i in rows if v is None)
    place = ranks.row_number(spark.range(1000).select((F.col("id") * 37 % 1009).alias("k")), "k", "p").orderBy("k").collect()
    assert [r["p"] for r in place] == list(range(1000))


def test_vectors_in_blocks_agree(spark):
    import numpy as np

    from marlspike.operators import search as R

    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 8)]) for i in range(300)] + [(300, [0.0] * 8)]
    v = spark.createDataFrame(rows, "doc_id long, vector array<float>").repartition(3)
    q = spark.createDataFrame(rows[:7], "query_id long, q array<float>")
    get = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())
    m = np.array([x for _, x in rows])
    size = np.sqrt((m * m).sum(1))
    want = []
    for i in range(7):
        s = np.round(m @ m[i] / np.where(size * size[i] > 0, size * size[i], 1), 6)
        want += [(i, k + 1, int(d), float(s[d])) for k, d in enumerate(np.lexsort((np.arange(301), -s))[:5])]
    assert [x[:3] for x in get(R.vector_top(v, q, 5))] == [x[:3] for x in want] and get(R.vector_top(v, q, 5, block=2)) == get(R.vector_top(v, q, 5))


def test_resumed_stream_gives_the_whole_result(spark, tmp_path):
    from marlspike.streaming import streams

    events = lambda a, b: spark.range(a, b).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("x").alias("event_type"), F.lit(1.0).alias("value"))
    folder = f"{tmp_path}/in"
    one = lambda: streams.run_available(streams.events(spark, f"{folder}/*.parquet").select("event_id", "ts"), "append", spark, f"file://{tmp_path}/state")
    events(0, 10).write.parquet(folder)
    assert one().count() == 10
    events(10, 25).write.mode("append").parquet(folder)
    again = one()
    assert again.count() == 25 and again.select("_batch").distinct().count() == 2 and one().count() == 25
