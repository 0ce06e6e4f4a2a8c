"""The pipeline's stages against plain Python, and odd rows."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as cp
from marlspike.llm.queries import tokenizer_path

from .test_cases import TEXTS, WORD, brute_groups, brute_overlaps, frame


def test_stages_follow_one_another(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = cp.quality_rules(spark, docs, sf_dir)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    single = cp.near_duplicates(spark, kept, sf_dir)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(d for d, _, low, _ in brute_groups(rows, 5, 80) if d == low)
    clean = cp.decontaminate(spark, single, sf_dir)
    mixed = cp.mix_sources(spark, clean, sf_dir)
    assert mixed.columns == docs.columns and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 3
    out = cp.encode(spark, mixed, sf_dir)
    assert out.count() == mixed.count()


def test_run_returns_the_last_stage(spark, sf_dir):
    assert cp.run(spark, sf_dir).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_odd_rows_and_empty_tables(spark, sf_dir):
    for rows in (TEXTS, []):
        docs = frame(spark, rows)
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns
            out.collect()
    twice = frame(spark, [(5, "the same row twice")] * 3)
    assert cp.near_duplicates(spark, twice, sf_dir).count() == 1


def test_decontaminate_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(21)
    items = [(i, " ".join(f"i{i}t{j}" for j in range(n))) for i, n in enumerate((4, 7, 10, 13, 20, 40))]
    spark.createDataFrame([(i, t, "clash", 1, "x") for i, t in items], "item_id long, text string, doc_id string, h long, _key string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = []
    for k in range(60):
        w = items[k % 6][1].split()
        for p in rng.choice(len(w), int(rng.integers(0, len(w) // 2 + 1)), replace=False):
            w[p] = f"z{rng.integers(10**6)}"
        rows.append((k, " ".join([f"a{k}", "b", *w, "c", f"d{k}"])))
    rows += [(100, None), (101, ""), (102, "clean"), (None, items[5][1]), (103, items[5][1]), (103, items[5][1])]
    docs = frame(spark, rows)
    kept = Counter(r["doc_id"] for r in cp.decontaminate(spark, docs, str(tmp_path)).collect())
    bad = {d for d, _ in brute_overlaps(rows, items)}
    assert kept == Counter(d for d, _ in rows if d not in bad) and 20 < len(bad) < 60


def test_mix_against_plain_python(spark, sf_dir):
    """Targets by water filling, copies by counting the whole numbers crossed, for each of the offsets."""
    rng = np.random.default_rng(22)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), "abcd"[int(rng.integers(0, 4)) if i % 3 else 0]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("doc_id", "text", "'en' as lang", "source", "length(text) as n_chars")
    got = Counter(r["doc_id"] for r in cp.mix_sources(spark, docs, sf_dir).collect())
    size = {i: len(WORD.findall(t)) for i, t, _ in rows}
    own = defaultdict(list)
    for i, _, s in rows:
        own[s].append(i)
    whole = {s: sum(size[i] for i in x) for s, x in own.items()}
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(own))}
    left, open_, target = sum(whole.values()), set(own), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * whole[s] < level * weight[s]}
        for s in full or open_:
            target[s] = 3 * whole[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        open_ -= full or open_
    want = Counter()
    for s, x in own.items():
        bits = int(hashlib.md5(f"7|{s}".encode()).hexdigest()[:5], 16)
        expect, best = round(target[s] / whole[s] * 10**8), None
        ranked = sorted(x, key=lambda i: (-size[i], i))
        for hands in (1, 2, 3, 5, 7):
            order = [i for hand in range(hands) for i in ranked[hand::hands]]
            for k in range(8):
                start = (k * 2**20 + bits) * 10**8 // 2**23
                copies = {i: ((r + 1) * expect + start) // 10**8 - (r * expect + start) // 10**8 for r, i in enumerate(order)}
                best = min(best or (np.inf, 0, 0, {}), (abs(sum(c * size[i] for i, c in copies.items()) - target[s]), hands, k, copies), key=lambda b: b[:3])
        want.update(best[3])
        assert best[0] <= 40
    assert got == +want


@pytest.mark.parametrize("rows", [TEXTS, [], [(5, "the same row twice")] * 3])
def test_encode_odd_rows(spark, sf_dir, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in cp.encode(spark, frame(spark, rows), sf_dir).collect()), key=lambda x: x[1])
    want, at = [], 0
    for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_repeated_rows_keep_one_defined_row(spark):
    rows = [(5, "the same row twice", lang) for lang in ("fr", "de", None, "en")]
    docs = spark.createDataFrame([(i, t, x, "s", 1) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {cp.near_duplicates(spark, docs.repartition(n), "").first()["lang"] for n in (1, 3)} == {None}
