"""Price files of many series: no folder for each of them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marlspike.plans import catalogue, run_queries
from marlspike.sources import tables as TB
from marlspike.sources.scratch import file_system, fresh_path


def test_series_share_files(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(run_queries, "fresh_path", lambda s, name: seen.append(fresh_path(s, name)) or seen[-1])
    rows = catalogue.queries()["scan_price_csv"](spark, sf_dir)
    fs, place = file_system(spark, seen[0])
    assert not any(x.isDirectory() for x in fs.listStatus(place))
    assert rows.select("ticker").distinct().count() == 10 and rows.where(F.col("ticker").isNull() | F.col("close").isNull()).count() == 0


def test_keys_stand_before_the_bars(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ticker,date,open,high,low,close,volume\n7,2020-01-02,1,2,0.5,1.5,10\n8,2020-01-02,x,2,0.5,1.5,10\n8,2020-01-03,1,2,0.5,1.5,11\n")
    got = TB.price_csv(spark, str(tmp_path), "ticker bigint")
    assert sorted((r["ticker"], r["volume"]) for r in got.collect()) == [(7, 10), (8, 11)]
    (tmp_path / "a.csv").write_text("ticker,date,open,high,low,close,volume\n")
    with pytest.raises(ValueError):
        TB.price_csv(spark, str(tmp_path), "ticker bigint")
