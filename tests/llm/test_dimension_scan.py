"""Nearest neighbours against brute force, and the scan's own rule."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlspike.llm import dimension_scan
from marlspike.llm.queries import op11_dimension_scan

SCHEMA = "vec_id long, embedding array<double>, id string, list int, a int, v string, bound int, turned int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", 1, 2, "x", 3, 4) for i, v in rows], SCHEMA)


def brute(rows, asked, k=5):
    """Of each asked id its k nearest (score, id), by plain loops."""
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if asked(q):
            own = sorted(((-float(x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y))), i) for i, y in good if i != q))[:k]
            out[q] = [(i, -s) for s, i in own]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) / len(w) for q, w in want.items() if w])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_recall(spark, sf):
    folder = f"/root/testdata/{sf}"
    df = op11_dimension_scan(spark, folder)
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, got = brute(rows, lambda q: q % 50 == 0), found(df)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert recall(got, want) >= 0.95
    scores = {q: dict(w) for q, w in want.items()}
    assert all(abs(s - scores[q][i]) < 1e-12 for q, own in got.items() for i, s in own if i in scores[q])


def test_clusters_and_many_copies(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 40))
    rows = [(i, (centres[i % 12] * 3 + rng.standard_normal(40)).tolist()) for i in range(1500)]
    rows = [(i, rows[7][1] if i % 3 == 0 else v) for i, v in rows]  # a third is one vector
    got, want = found(dimension_scan.nearest(frame(spark, rows), F.col("id") % 50 == 0)), brute(rows, lambda q: q % 50 == 0)
    assert recall(got, want) >= 0.95
    for q in want:
        if q % 3 == 0:
            assert [i for i, _ in got[q]] == [i for i in range(0, 30, 3) if i != q and i != 7][:5] or 7 in [i for i, _ in got[q]]


def test_few_and_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 1.0]), (9, [1.0]), (50, [0.0, 1.0, 1.0])]
    got = found(dimension_scan.nearest(frame(spark, rows), F.col("id") % 50 == 0))
    assert got[0] == [(1, 1.0), (2, 1.0), (9, 1.0), (50, 0.0)]  # [1] counts as [1, 0, 0]
    assert got[50] == [(0, 0.0), (1, 0.0), (2, 0.0), (9, 0.0)] and got.keys() == {0, 50}
    assert dimension_scan.nearest(frame(spark, []), F.col("id") % 50 == 0).collect() == []
    assert dimension_scan.nearest(frame(spark, [(0, [1.0])]), F.col("id") % 50 == 0).collect() == []


def test_scan_abandons_far_candidates_only():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    q = x[:50]
    d = ((q[:, None] - x[None]) ** 2).sum(2)
    bound = np.sort(d, axis=1)[:, 5].astype(float)
    i, j = dimension_scan.scan(q, x, bound)
    near = {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= bound[:, None]))}
    kept = set(zip(i.tolist(), j.tolist()))
    assert kept <= {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= bound[:, None] * 1.0001 + 1e-5))}
    assert len(near & kept) >= 0.98 * len(near)
    stay = np.ones(d.shape, bool)
    for n, most in ((16, 0.9), (32, 0.6), (48, 0.15)):  # the share of candidates still read after so many of 64 columns
        stay &= ((q[:, None, :n] - x[None, :, :n]) ** 2).sum(2) <= dimension_scan._limit(bound, n, 64)[:, None]
        assert stay.mean() < most


def test_quantile_is_that_of_a_rotated_vector():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200_000, 64)) ** 2
    for d in (16, 48):
        part = x[:, :d].sum(1) / x.sum(1)
        assert 0.0005 < (part > dimension_scan.share_quantile(d, 64)).mean() < 0.0015


def test_odd_list_sizes_of_chunks_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(dimension_scan, "CHUNK", 7)
    monkeypatch.setattr(dimension_scan, "BLOCK", 3)
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(9).tolist()) for i in range(400)]
    assert recall(found(dimension_scan.nearest(frame(spark, rows), F.col("id") % 10 == 0)), brute(rows, lambda q: q % 10 == 0)) >= 0.95
