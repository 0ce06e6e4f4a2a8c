"""Compaction against a plain version that packs one file after another, and its files on disk."""

from __future__ import annotations

import datetime as dt
import glob
import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from marlspike.llm import packing
from marlspike.llm.queries import op13_lockstep_packing

EPOCH = dt.datetime(1970, 1, 1)
NOT_A_NUMBER = float("nan")


def plain_path(uri):
    return "/" + uri.split(":", 1)[1].lstrip("/")


def expected(rows, key, time, value, columns):
    """The final files by the rule, one row after another."""
    total = len(rows)
    share = lambda x: 1 + total // x
    day_of = lambda r: None if r[time] is None else (r[time] - EPOCH).days
    days, files = defaultdict(list), defaultdict(list)
    for r in rows:
        days[day_of(r)].append(r)
    for day, held in days.items():
        for r in held:
            h = zlib.crc32(("" if r[key] is None else str(r[key])).encode())
            files[day, (h // 16) % (1 + len(held) // share(200)), min(h % 4, (h // 4) % 4)].append(r)
    none_first = lambda v: (v is not None, v or 0 if not isinstance(v, dt.datetime) else v)
    for f in files.values():
        f.sort(key=lambda r: ((r[time] is not None, r[time] or EPOCH), none_first(r[key])))
    out = []
    for day in days:
        groups = []
        for d, lot, piece in sorted((k for k in files if k[0] == day), key=lambda k: (-len(files[k]), k[1], k[2])):
            n = len(files[d, lot, piece])
            if n >= share(750):
                groups.append([math.inf, [(lot, piece)]])
                continue
            for g in groups:
                if g[0] + n <= share(400):
                    g[0] += n
                    g[1].append((lot, piece))
                    break
            else:
                groups.append([n, [(lot, piece)]])
        for _, members in groups:
            held = [r for m in members for r in files[day, *m]]
            ids = [r[key] for r in held if r[key] is not None]
            cents = sum(0 if r[value] is None or math.isnan(r[value]) else math.floor(100 * r[value] + 0.5) for r in held)
            out.append((day, *members[0], len(held), min(ids, default=None), max(ids, default=None), cents, ",".join(f"{a}-{b}" for a, b in members), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), ",".join(columns), len(members) > 1))
    return out


def same(spark, df, **named):
    columns = df.columns
    key, time, value = named.get("key", "click_id"), named.get("time", "arrived_at"), named.get("value", "value")
    rows = [r.asDict() for r in df.collect()]
    folder, out = packing.compact(df, **named)
    got = out.collect()
    plain = [tuple(r[c] for c in ("day", "lot", "piece", "n_rows", "min_id", "max_id", "cents", "sources", "ids_sha256", "columns", "rewritten")) for r in got]
    assert sorted(plain, key=repr) == sorted(expected(rows, key, time, value, columns), key=repr)
    data = glob.glob(f"{folder.removeprefix('file:')}/**/*.parquet", recursive=True)
    assert sorted(data) == sorted(plain_path(r["path"]) for r in got)
    return got, data


def test_stored_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/clicks.parquet")
    got, data = same(spark, df)
    assert any(r["rewritten"] for r in got) and any(not r["rewritten"] for r in got)
    by = {plain_path(r["path"]): r for r in got}
    for path in data[:40]:  # what a plain reader finds in the files
        t = pq.ParquetFile(path).read()
        r = by[path]
        assert t.column_names == df.columns and t.num_rows == r["n_rows"]
        assert hashlib.sha256(",".join(map(str, t["click_id"].to_pylist())).encode()).hexdigest() == r["ids_sha256"]


def test_untouched_files_are_the_first_ones(spark, sf_dir, monkeypatch):
    held = {}

    def seen(files, total, real=packing.plan):
        for r in files.collect():
            held[r["_path"]] = open(plain_path(r["_path"]), "rb").read()
        return real(files, total)

    monkeypatch.setattr(packing, "plan", seen)
    _, out = packing.compact(spark.read.parquet(f"{sf_dir}/clicks.parquet").where("arrived_at < '2024-01-10'"))
    kept = [r for r in out.collect() if not r["rewritten"]]
    assert kept
    for r in kept:
        assert open(plain_path(r["path"]), "rb").read() == held[r["path"]]


def test_odd_rows_hot_day_and_clashing_names(spark):
    rng = np.random.default_rng(3)
    rows = [(i if i % 17 else None, None if i % 23 == 0 else dt.datetime(2024, 1, 1 + (0 if i % 3 else int(rng.integers(0, 9))), int(rng.integers(0, 24))), [None, NOT_A_NUMBER, -0.015, 3.14159][i % 4], "x" * (i % 5), i, "d", i) for i in range(900)]
    rows += rows[:40]
    df = spark.createDataFrame(rows, "click_id long, arrived_at timestamp_ntz, value double, `day` string, _nth int, `Lot` string, _at int")
    got, _ = same(spark, df)
    assert {r["day"] for r in got} >= {None, 19723}
    few, _ = same(spark, df.limit(1))
    assert len(few) == 1


def test_other_names_and_empty(spark):
    rows = [(10 + i, dt.datetime(2024, 2, 1 + i % 3), float(i)) for i in range(60)]
    same(spark, spark.createDataFrame(rows, "n long, at timestamp_ntz, paid double"), key="n", time="at", value="paid")
    folder, out = packing.compact(spark.createDataFrame([], "click_id long, arrived_at timestamp_ntz, value double"))
    assert out.collect() == [] and "day" in out.columns


@pytest.mark.parametrize("seed", range(4))
def test_lockstep_is_first_fit(seed):
    rng = np.random.default_rng(seed)
    sizes = -np.sort(-rng.integers(0, 60, (int(rng.integers(1, 30)), int(rng.integers(1, 40)))), axis=1)
    got = packing.lockstep(sizes, 100)
    for day, own in zip(sizes, got):
        held = []
        for n, g in zip(day, own):
            if not n:
                assert g == -1
                continue
            first = next((k for k, h in enumerate(held) if h + n <= 100), len(held))
            held += [0] * (first == len(held))
            held[first] += n
            assert g == first


def test_query_columns(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(packing, "compact", lambda df: ("", spark.createDataFrame([], packing._RESULT)))
    out = op13_lockstep_packing(spark, sf_dir)
    assert out.columns == ["day", "lot", "piece", "n_rows", "min_click_id", "max_click_id", "cents", "sources", "ids_sha256", "columns", "path", "rewritten"]
