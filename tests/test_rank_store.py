"""Kept ranks against whole rankings, and what a merge reads and writes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlspike.operators import rank_store as RS
from marlspike.operators import ranks
from marlspike.sources.scratch import fresh_path

SCHEMA = "ticker long, feature string, value double"


def made_up(spark, seed, n=900):
    rng = np.random.default_rng(seed)
    pick = lambda: [None, float("nan"), 0.0, float(rng.normal()), float(rng.integers(0, 9))][int(rng.choice(5, p=[0.05, 0.05, 0.4, 0.4, 0.1]))]
    return spark.createDataFrame([(t, f, pick()) for t in range(n) for f in ("a", "b")] + [(1, "lone", 3.0), (2, "lone", None)], SCHEMA)


def same(spark, path, rows):
    clean = rows.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    want = {(r["ticker"], r["feature"]): r["pct"] for r in ranks.average_rank(clean, "value", ["feature"], "pct").collect()}
    got = RS.percentiles(spark, path).collect()
    assert len(got) == len(want) and {(r["ticker"], r["feature"]): r["pct"] for r in got} == want


def test_merges_equal_whole_rankings(spark, monkeypatch):
    monkeypatch.setattr(RS, "CUTS", 8)
    path, rows = fresh_path(spark, "ranks"), made_up(spark, 1)
    RS.build(rows, path)
    same(spark, path, rows)
    for step, (own, new) in enumerate([("ticker < 200", made_up(spark, 2).where("ticker < 200")), ("ticker % 5 = 0", made_up(spark, 3).where("ticker % 5 = 0 and ticker < 400")), ("false", made_up(spark, 4, 950).where("ticker >= 900"))]):
        RS.merge(spark, path, rows.where(own), new)
        rows = rows.where(f"not ({own})").unionByName(new).cache()
        same(spark, path, rows)


def test_only_changed_splits_are_written(spark, monkeypatch):
    monkeypatch.setattr(RS, "CUTS", 8)
    path = fresh_path(spark, "ranks")
    rows = spark.createDataFrame([(t, "a", float(t)) for t in range(800)], SCHEMA)
    RS.build(rows, path)
    touched = RS.merge(spark, path, rows.where("ticker = 5"), spark.createDataFrame([(5, "a", 7.5)], SCHEMA))
    assert [tuple(r) for r in touched.collect()] == [("a", 0)]
    live = {r["split"]: r["live"] for r in RS._live(spark, path).collect()}
    assert live == {0: 1, **{k: 0 for k in range(1, 8)}}
    assert {r["ticker"]: r["pct"] for r in RS.percentiles(spark, path).where("ticker in (4, 5, 6, 7, 8)").collect()} == {t: round(p / 799, 6) for t, p in ((4, 4), (6, 5), (7, 6), (5, 7), (8, 8))}


def test_merge_that_died_leaves_the_store(spark, monkeypatch):
    path, rows = fresh_path(spark, "ranks"), made_up(spark, 5, 100)
    RS.build(rows, path)
    real = RS._ranked
    monkeypatch.setattr(RS, "_ranked", lambda p: (real(p)[0].withColumn("ticker", F.raise_error(F.lit("lost")).cast("long")), 1))
    with pytest.raises(Exception, match="lost"):
        RS.merge(spark, path, rows.where("ticker < 9"), made_up(spark, 6, 9))
    monkeypatch.undo()
    same(spark, path, rows)
