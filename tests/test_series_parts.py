"""Series are made in as many parts as the lines ask for, and what is read again is a table."""

from __future__ import annotations

from marlspike.plans import domain
from marlspike.plans import forecast_queries as Q


def test_bars_take_parts_by_lines(spark, sf_dir, monkeypatch):
    want = sorted(map(tuple, domain.bars(spark, sf_dir).collect()), key=repr)
    monkeypatch.setattr(domain, "LINES", 500)
    many = domain.bars(spark, sf_dir)
    assert many.rdd.getNumPartitions() == 12 and sorted(map(tuple, many.collect()), key=repr) == want  # 6,000 lines


def test_scenarios_and_parts_read_tables(spark, sf_dir):
    for made in (Q._scenarios(spark, sf_dir), Q._parts(spark, sf_dir)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan
