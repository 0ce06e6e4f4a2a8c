"""Every registered query of the analytics part against its SQL on the smallest tables."""

from __future__ import annotations

import datetime as dt
import math

import duckdb
import pytest

from marlspike.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return float(v)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    rel = duck.execute(ORACLES[name])
    names = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_leaderboard_ranks_eight_models(spark, sf_dir):
    got = {r["model"]: r["mae"] for r in catalogue.queries()["ml_leaderboard"](spark, sf_dir).collect()}
    assert len(got) == 8 and all(0 < e < 1 for e in got.values()) and got["historical-mean baseline"] == got["market-return baseline"]
