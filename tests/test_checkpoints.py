"""Batch checkpoints: lazy scans, pushed filters, landed tables."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from marlspike.sources import checkpoints as CP

SCHEMA = "batch int, ticker string, status string, error string, payload string"


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(t // 5, f"t{t}", "pending" if t == 19 else "failed" if t == 7 else "ok", "E" if t == 7 else None, '{"x": %d}' % t) for t in range(20)]
    CP.write(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}")
    return str(tmp_path)


def test_complete_batches_unless_partial(spark, folder):
    assert {r["ticker"] for r in CP.scan(spark, folder).collect()} == {f"t{t}" for t in range(15)}
    assert CP.scan(spark, folder, partial=True).count() == 20
    row = CP.scan(spark, folder).where("status = 'failed'").first()
    assert tuple(row) == (1, "t7", "failed", "E", '{"x": 7}')


def test_a_ticker_opens_one_file(spark, folder):
    for path in glob.glob(f"{folder}/*.jsonl"):
        if not path.endswith("batch-1.jsonl"):
            os.rename(path, f"{path}.away")  # a read of these would fail
    assert [r["payload"] for r in CP.scan(spark, folder).where("ticker = 't6'").collect()] == ['{"x": 6}']
    assert CP.scan(spark, folder).where(F.col("ticker").isin("t5", "t9", "none")).count() == 2
    assert CP.scan(spark, folder).where("batch = 1 and status = 'ok'").count() == 4
    assert CP.scan(spark, folder).where("ticker = 'none'").collect() == []


def test_partitions_are_the_batches_that_can_match(folder):
    reader = CP.CheckpointReader(folder, True)
    left = list(reader.pushFilters([CP.EqualTo(("ticker",), "t12"), CP.In(("batch",), (1, 2)), CP.EqualTo(("status",), "ok")]))
    assert [f.attribute for f in left] == [("status",)] and [(p.number, p.tickers) for p in reader.partitions()] == [(2, ["t12"])]


def test_providers_agree(spark, folder):
    own = CP.CheckpointProvider(spark, folder)
    fixture = CP.FixtureProvider(CP.scan(spark, folder))
    for tickers in (None, ["t1", "t14"]):
        assert sorted(map(tuple, own.rows(tickers).collect()), key=repr) == sorted(map(tuple, fixture.rows(tickers).collect()), key=repr)


def test_landed_table_is_reused_unless_forced_changed_or_incomplete(spark, tmp_path):
    made = []

    def make(value="v"):
        made.append(value)
        return spark.createDataFrame([(1, value)], "id int, v string")

    good, path = F.col("v") == "v", f"file://{tmp_path}/b"
    assert [CP.landed(make, path, spark, "k", good)[1] for _ in range(2)] == [False, True]
    assert not CP.landed(make, path, spark, "k", good, force=True)[1] and not CP.landed(make, path, spark, "other", good)[1]
    CP.landed(lambda: make("bad"), path, spark, "k", good, force=True)
    assert not CP.landed(make, path, spark, "k", good)[1] and len(made) == 5


def test_empty_folder(spark, tmp_path):
    assert CP.scan(spark, str(tmp_path)).collect() == []
