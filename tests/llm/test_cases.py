"""Odd inputs for every corpus operator, and results held against brute force."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlspike.llm import common, crf_toxicity, hilbert, host_rules, line_chunks, mixing, ordinal_quality, ppm_language, signature_join, spaced_seeds, token_blocks
from marlspike.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _at long, _key string, _pid int, size string, h long, n int, vid long, _n string, w int, i int, label int, _row int, curve int, c int"
LONG = " ".join(f"w{i}x" for i in range(60_000))
TEXTS = [(None, "an unnumbered document of a few words"), (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "the same row twice"), (5, "the same row twice"), (6, "one"), (7, "éü 中文 mixed\nlines\n\nhere."), (8, "12 34 ,. !")]


def frame(spark, rows, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang if k % 3 else None, source if k % 2 else None, None if k % 4 == 0 else len(t or ""), 1, "k", 2, "z", 3, 4, 5, "x", 6, 7, 8, 9, 10, 11) for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, TEXTS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int, label string, text string")


OPERATORS = {
    "toxicity": lambda s, d: crf_toxicity.toxicity(d, labels(s, [(4, 1, 0, "", ""), (6, 1, 1, "", ""), (7, None, None, "", "")])),
    "join": lambda s, d: signature_join.near_duplicates(d),
    "language": lambda s, d: ppm_language.language(d),
    "quality": lambda s, d: ordinal_quality.quality(d, labels(s, [(4, 1, 0, "", ""), (6, 0, 1, "", "")])),
    "shards": lambda s, d: hilbert.shard(d, ["lang", "source", "n_chars", "doc_id"]),
    "blocks": lambda s, d: token_blocks.read_files(token_blocks.write_files(d, tokenizer_path())),
    "mix": lambda s, d: mixing.mix(d),
    "hosts": lambda s, d: host_rules.judge(d),
    "lines": lambda s, d: line_chunks.dedup_lines(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_come_back_once_each(spark, odd, name):
    got = OPERATORS[name](spark, odd).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in TEXTS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, none, name):
    assert OPERATORS[name](spark, none).collect() == []


def test_seeds_odd_and_empty(spark, odd, none):
    rows = [(1, "w10x w11x w12x w13x w14x w15x w16x w17x w18x w19x w20x w21x"), (2, None), (3, ""), (4, "the same row thrice"), (5, "an unnumbered document of a few words"), (6, "lines here"), (7, "ONE")]
    items = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], "item_id long, text string, doc_id string, w int, seed int")
    got = {(r["doc_id"], r["item_id"]) for r in spaced_seeds.overlaps(odd, items).collect()}
    assert got == {(4, 1), (5, 4), (None, 5), (7, 6), (6, 7)}  # three tokens of four, and items of one or two tokens
    assert spaced_seeds.overlaps(none, items).collect() == [] and spaced_seeds.overlaps(odd, items.limit(0)).collect() == []
    twice = spaced_seeds.overlaps(odd.union(odd), items.union(items)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in twice} == got


def brute_overlaps(docs, items):
    """All alignments, without seeds."""
    token = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    found = set()
    for d, dt in docs:
        w = token(dt)
        for i, it in items:
            v = token(it)
            n = len(v)
            for shift in range(-n + 1, len(w)):
                same = [0 <= j + shift < len(w) and w[j + shift] == v[j] for j in range(n)]
                for a in range(max(n - 3, 1) if n else 0):
                    part = same[max(0, a - spaced_seeds.BEFORE) : a + spaced_seeds.AFTER]
                    if 100 * sum(part) >= spaced_seeds.RATIO * len(part) or sum(same[a : a + spaced_seeds.RUN]) == spaced_seeds.RUN:
                        found.add((d, i))
    return found


def test_seeds_against_brute_force(spark):
    rng = np.random.default_rng(12)
    items = [(n, " ".join(f"i{n}t{j}" if j % 3 else f"common{j % 7}" for j in range(n))) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 19, 26, 40)]
    docs = []
    for n, text in items:
        for k in range(30):
            w = text.split()
            for p in rng.choice(n, min(n, int(rng.integers(0, n // 3 + 2))), replace=False):
                w[p] = f"z{rng.integers(10**6)}"
            cut = int(rng.integers(0, n)) if k % 5 == 0 else 0
            docs.append((len(docs), " ".join([*(f"x{rng.integers(10**6)}" for _ in range(5)), *w[cut:], *(f"y{rng.integers(10**6)}" for _ in range(5))])))
    docs = [(100 * i, t) for i, t in docs]
    got = {(r["doc_id"], r["item_id"]) for r in spaced_seeds.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_overlaps(docs, items)
    assert len(want) > 150 and got <= want and len(got) >= 0.99 * len(want)


def _recall(n, patterns):
    """Of patterns of agreeing tokens that are an overlap, the share with a seed whose stretch is one."""
    upto = np.concatenate([np.zeros((len(patterns), 1), int), np.cumsum(patterns, 1)], 1)

    def overlap(a):
        s, e = max(0, a - spaced_seeds.BEFORE), min(n, a + spaced_seeds.AFTER)
        ok = 100 * (upto[:, e] - upto[:, s]) >= spaced_seeds.RATIO * (e - s)
        return ok | (upto[:, a + spaced_seeds.RUN] - upto[:, a] == spaced_seeds.RUN) if a + spaced_seeds.RUN <= n else ok

    want = np.any([overlap(a) for a in range(max(n - 3, 1))], 0)
    found = np.zeros(len(patterns), bool)
    for m in spaced_seeds.masks_of([n]):
        for a in range(n - m[-1]):
            found |= patterns[:, [a + p for p in m]].all(1) & overlap(a)
    return (found & want).sum() / max(want.sum(), 1)


@pytest.mark.parametrize("n", [*range(1, 21), 24, 30, 45, 60])
def test_seeds_hit_at_every_item_length(n):
    """Every pattern of substitutions the ratio allows (random ones of long items); all are hit up to 15 tokens."""
    rng = np.random.default_rng(13)
    for changed in range(n // 4 + 1):
        if n <= 20:
            places = list(itertools.combinations(range(n), changed))
        else:
            places = [rng.choice(n, changed, replace=False) for _ in range(3000)]
        places = np.array(places, int).reshape(len(places), changed)
        patterns = np.ones((len(places), n), bool)
        for j in range(changed):
            patterns[np.arange(len(places)), places[:, j]] = False
        assert _recall(n, patterns) >= (1.0 if n <= 15 else 0.97)


def brute_groups(rows, k, t):
    sets = []
    for _, text in rows:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        sets.append(frozenset() if not w else frozenset([tuple(w)]) if len(w) < k else frozenset(zip(*(w[i:] for i in range(k)))))
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= t * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    low = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low[find(i)], d)
    return [(d, len(s), low[find(i)], n) for i, ((d, _), s, n) in enumerate(zip(rows, sets, links))]


@pytest.mark.parametrize("k,t", [(3, 90), (5, 80)])
def test_join_against_brute_force(spark, docs, k, t):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rng = np.random.default_rng(1)
    base = [f"b{i}" for i in range(60)]
    for i in range(60):  # a family of near copies, some a little too far
        w = list(base)
        for p in rng.integers(0, 60, rng.integers(0, 4)):
            w[p] = f"x{rng.integers(1000)}"
        rows.append((1000 + i, " ".join(w)))
    got = signature_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, t).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got) == sorted(brute_groups(rows, k, t))


def test_join_in_blocks_agrees(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"b{j}" if rng.random() > 0.02 else f"x{rng.integers(99)}" for j in range(50))) for i in range(120)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(signature_join, "BLOCK_SETS", 20)
    monkeypatch.setattr(signature_join, "BROADCAST_ROWS", 0)
    got = signature_join.near_duplicates(d, 3, 60).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got) == sorted(brute_groups(rows, 3, 60))


def test_part_keys_keep_all_linking_pairs():
    rng = np.random.default_rng(3)
    classes = signature_join.size_classes(80)
    for n in (1, 2, 3, 5, 9, 10, 14, 15, 22, 33, 34, 70, 150, 400):
        a = np.unique(rng.integers(1, 1 << 62, n).astype(np.uint64))
        for drop in range(0, max(1, n // 4)):
            b = np.unique(np.concatenate([a[drop:], rng.integers(1, 1 << 62, rng.integers(0, n // 5 + 1)).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
                key, own = signature_join.part_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 80, classes)
                assert np.intersect1d(key[own == 0], key[own == 1]).size


def test_hilbert_visits_neighbours():
    for d, b in ((2, 4), (3, 3), (4, 2)):
        g = np.stack(np.meshgrid(*[np.arange(1 << b)] * d, indexing="ij"), -1).reshape(-1, d)
        h = hilbert.hilbert_index(g, b)
        assert sorted(h) == list(range(len(g))) and np.abs(np.diff(g[np.argsort(h)], axis=0)).sum(1).max() == 1


def test_shards_are_even_and_gapless(spark, docs):
    got = hilbert.shard(docs, ["lang", "source", "n_chars", "doc_id"]).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 1


def test_shards_follow_the_curve_and_keep_equal_texts_together(spark, docs):
    """Slots against a curve worked out here, from exact quantiles; a group of equal texts is one run."""
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").collect()
    got = {r["doc_id"]: r for r in hilbert.shard(docs, ["lang", "source", "n_chars", "doc_id"]).collect()}
    order = sorted(got.values(), key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in order] == sorted(r["curve"] for r in order)
    n, cells = len(rows), []
    for c in ("lang", "source"):
        of = Counter(r[c] for r in rows)
        at, cell, seen = 0, {}, 0
        for v in sorted(of, key=lambda v: v.encode()):
            middle = (2 * at + of[v]) * 16 // (2 * n)
            at += of[v]
            cell[v] = seen = max(seen, middle)
        ranks = sorted(set(cell.values()))
        cells.append([ranks.index(cell[r[c]]) for r in rows])
    for c in ("n_chars", "doc_id"):
        values = sorted(r[c] for r in rows)
        border = {values[max(-(-k * n // 16) - 1, 0)] for k in range(1, 16)} - {values[0]}
        cells.append([sum(r[c] >= b for b in border) for r in rows])
    curve = hilbert.hilbert_index(np.array(cells).T, 4)
    first = {}
    for r, k in zip(rows, curve.tolist()):
        first[r["text"]] = min(k, first.get(r["text"], k))
    assert all(got[r["doc_id"]]["curve"] == first[r["text"]] for r in rows)
    place = {r["doc_id"]: i for i, r in enumerate(order)}
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"]].append(place[r["doc_id"]])
    assert any(len(g) > 1 for g in groups.values()) and all(max(g) - min(g) == len(g) - 1 for g in groups.values())


def test_cells_tell_prefixes_and_outliers_apart(spark):
    rows = [(i, f"https://example.org/a-long-common-path/{i % 16:02d}", 10**12 if i == 7 else i % 64) for i in range(640)]
    d = common.materialize(spark.createDataFrame(rows, "doc_id long, url string, n long"))
    found = hilbert.borders(d, ["url", "n"], 4)
    assert len(found["url"]) >= 14 and len(found["n"]) >= 14


def test_blocks_round_trip():
    rng = np.random.default_rng(4)
    for n in (0, 1, 1023, 1024, 1025, 5000):
        ids = rng.integers(0, 50257, n).astype(np.uint32)
        ids[rng.random(n) < 0.01] = 4_000_000_000
        names, lengths, back = token_blocks.decode_file(token_blocks.encode_file([7, None], np.array([n // 3, n - n // 3]), ids))
        assert names == [7, None] and (back == ids).all()
    with pytest.raises(ValueError):
        token_blocks.read_header(b"none of ours")


def test_stretches_give_the_librarys_ids(docs):
    enc = token_blocks.Encoder(tokenizer_path())
    texts = [r["text"] for r in docs.select("text").limit(100).collect()]
    texts += ["", " a", "a ", "a  b", "a \n b", "it's don't 's.", "x, y. z", "word. Word.\nIt, is.", "<|endoftext|> a b", "é, 中. 12, 3.", "a\x01b c", ", . ,", "\n", "a\nb", "x\u00a0y z", "x\u2003y", "“quoted” — dash … end", "AND!! of%%% x_y a`b (c) [d] q{}", "don't... z's!!", "a\n!!b\n12", "Ωμέγα. жук, ԱԲ.", "ab1 c2, d.", "　wide", "A..", "a.,b", "a\tb"]
    for _ in range(2):  # the second time from memory
        ids, count = enc.encode(pa.array(texts, pa.string()))
        for t, x in zip(texts, np.split(ids, np.cumsum(count)[:-1])):
            assert enc.tok.encode(t, add_special_tokens=False).ids == x.tolist()


def test_blocks_query(spark, docs):
    from tokenizers import Tokenizer

    tok, at = Tokenizer.from_file(tokenizer_path()), 0
    got = {r["doc_id"]: r for r in token_blocks.read_files(token_blocks.write_files(docs, tokenizer_path())).collect()}
    for r in docs.orderBy("doc_id").collect():
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[r["doc_id"]]["start"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_mix_meets_targets(spark, docs):
    got = mixing.mix(docs).collect()
    sources = defaultdict(list)
    for r in got:
        sources[r["source"]].append(r)
        assert r["taken"] <= 3 * r["size"]
    total = sum(r["size"] for r in got)
    assert sum(x[0]["target"] for x in sources.values()) == pytest.approx(total)
    for s, x in sources.items():
        assert x[0]["target"] <= 3 * x[0]["source_size"] and abs(sum(r["taken"] for r in x) - x[0]["target"]) <= max(r["size"] for r in x)  # ten documents each
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs).collect()))


def test_mix_is_systematic(spark):
    """Copies in every stretch of the order within one of what is expected, so each document's are rounded down or up; words within the largest document."""
    rng = np.random.default_rng(14)
    rows = [(i, "w " * int(rng.integers(1, 60)), "abc"[i % 3]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    for s in "abc":
        ranked = sorted((r for r in got if r["source"] == s), key=lambda r: (-r["size"], r["doc_id"]))
        expect = ranked[0]["target"] / ranked[0]["source_size"]
        deals = [[r for hand in range(m) for r in ranked[hand::m]] for m in mixing.HANDS]
        own = min(deals, key=lambda own: np.ptp(np.cumsum([r["copies"] for r in own]) - expect * np.arange(1, len(own) + 1)))
        off = np.cumsum([r["copies"] for r in own]) - expect * np.arange(1, len(own) + 1)
        assert off.max() - off.min() <= 1 + 1e-4 and {r["copies"] for r in own} <= {int(expect), int(expect) + 1}
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 5


def test_mix_follows_its_seed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one, two = ({r["doc_id"]: r for r in mixing.mix(docs, seed=s).collect()} for s in ("7", "8"))
    assert sum(one[i]["copies"] != two[i]["copies"] for i in one) > 0
    for got in (one, two):
        sources = defaultdict(list)
        for r in got.values():
            sources[r["source"]].append(r)
            expect = r["target"] / r["source_size"]
            assert r["copies"] in (int(expect), int(expect) + 1)
        for own in sources.values():
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.03 * own[0]["target"]


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), (None, 500)], "_source string, size long")
    got = {r["_source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["b"] == 30 and got["c"] == 30 and got["a"] + got[None] == pytest.approx(1460) and got["a"] == pytest.approx(got[None])


def test_counts_against_brute_force(spark, odd, docs):
    rows = TEXTS + [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").limit(150).collect()] + [(90, "a b c d e a b c d e f"), (91, "x\nx\n\n\ny x\nx")]
    d = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "k long, text string")
    got = {r["k"]: r for r in host_rules.document_counts(d, "text", [F.col("k")]).collect()}
    for k, (_, t) in enumerate(rows):
        t = t or ""
        w = WORD.findall(t)
        windows = Counter(zip(*(w[i:] for i in range(5))))
        covered = {i + j for i, g in enumerate(zip(*(w[i:] for i in range(5)))) if windows[g] > 1 for j in range(5)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        assert [got[k][c] for c in host_rules.COUNTS] == [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)]


def test_bad_host_goes_good_host_stays(spark):
    rows = [(i, "w%d v%d only few" % (i, i) if i % 10 else "a fine text of more than ten words that differ from one another %d" % i, "bad") for i in range(200)]
    rows += [(1000 + i, "a fine text of more than ten words that differ from one another %d" % i, "good") for i in range(200)]
    got = host_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert not any(r["kept"] for r in got if r["doc_id"] < 1000) and all(r["kept"] for r in got if r["doc_id"] >= 1000)


def test_host_verdict_reaches_the_query(spark, tmp_path):
    """op8's query over documents with one bad host, against its SQL: clean documents of that host go, others stay."""
    import duckdb

    from marlspike.llm import queries

    fine = "a fine text of more than ten words that differ from one another %d"
    rows = [(i, "w%d v%d only few" % (i, i) if i % 10 else fine % i, "bad") for i in range(200)] + [(1000 + i, fine % i if i % 7 else "few", f"good{i % 9}") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op8_host_rules(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.execute(queries.ORACLE_SQL["op8_host_rules"])
    names = [c[0] for c in rel.description]
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(rel.fetchall())
    assert sum(not r["kept"] and not r["base_failed"] for r in got) == 20 and all(r["doc_id"] < 200 for r in got if not r["kept"] and not r["base_failed"])


def test_long_texts_are_learned_from(spark):
    """A language whose texts are all very long."""
    rng = np.random.default_rng(18)
    words = lambda letters, n: " ".join("".join(rng.choice(list(letters), int(rng.integers(2, 8)))) for _ in range(n))
    long_ = words("pqxyz", 45_000)
    rows = [(i, long_[i * 1000 :], "xx") for i in range(12)] + [(100 + i, words("abcde", 40), "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in ppm_language.language(docs).collect()}
    assert got == {i: x for i, _, x in rows}


def test_repeated_passages_go_common_lines_stay(spark):
    rng = np.random.default_rng(5)
    line = lambda n: " ".join(f"q{rng.integers(10**6)}" for _ in range(n))
    passage = [line(9) for _ in range(7)]
    single = line(60)
    rows = [(i, "\n".join(["a common line", line(12), line(20), *passage, line(30), line(8)])) for i in range(4)]
    rows += [(10 + i, "\n".join([line(15), single, line(15)])) for i in range(3)] + [(20, "\n".join(["a common line", line(10)]))]
    got = {r["doc_id"]: r for r in line_chunks.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["text"] == rows[0][1] and got[10]["text"] == rows[4][1] and got[20]["text"] == rows[7][1]
    assert all(got[i]["n_removed"] >= 5 and "a common line" in got[i]["text"] for i in (1, 2, 3)) and all(single not in got[i]["text"] for i in (11, 12))


def test_short_lines_of_a_long_passage_go(spark):
    """Every passage of 4 to 8 short lines with 50 words or more goes from its second context, whatever the cuts."""
    rng = np.random.default_rng(8)
    line = lambda n: " ".join(f"p{rng.integers(10**9)}" for _ in range(n))
    rows, want = [], {}
    for i in range(100):
        n_lines = 4 + i % 5
        passage = [line(-(-(50 + int(rng.integers(11))) // n_lines)) for _ in range(n_lines)]
        for side in (0, 1):
            before, after = [[line(int(rng.integers(3, 15))) for _ in range(int(rng.integers(1, 5)))] for _ in range(2)]
            rows.append((2 * i + side, "\n".join([*before, *passage, *after])))
            want[2 * i + side] = "\n".join([*before, *after]) if side else rows[-1][1]
    again = line(13)
    rows += [(1000, "\n".join(["start", *[again] * 5, "end"])), (1001, "\n".join([again] * 5 + ["other"]))]
    want |= {1000: f"start\n{again}\nend", 1001: "other"}
    got = {r["doc_id"]: r["text"] for r in line_chunks.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


@pytest.mark.parametrize("gap", ["\n\n\n", "\n\n\n\n", "\n \n\t\n"])
def test_blank_lines_end_no_run(spark, gap):
    """Paragraphs of under 50 words go together over any number of blank lines, also where these differ."""
    rng = np.random.default_rng(11)
    line = lambda n: " ".join(f"b{rng.integers(10**9)}" for _ in range(n))
    rows, want = [], {}
    for i, (many, n) in enumerate([(3, 20), (2, 30), (4, 14)] * 15):
        paragraphs = [line(n) for _ in range(many)]
        for side, between in ((0, "\n\n"), (1, gap), (2, gap)):
            rows.append((3 * i + side, f"{(a := line(9))}\n{between.join(paragraphs)}\n{(b := line(9))}"))
            want[3 * i + side] = f"{a}\n{b}" if side else rows[-1][1]
    got = {r["doc_id"]: r["text"] for r in line_chunks.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_boundaries_decide_the_chunks(spark, docs, monkeypatch):
    """Without boundaries nothing but single long lines goes; a chunk is the same wherever its lines stand."""
    h = np.random.default_rng(17).integers(0, 2**63, 400).astype(np.uint64)
    doc = np.repeat([0, 1], 200)
    key, start, end = line_chunks.runs(h, doc)
    assert (end > start).all() and (doc[start] == doc[end]).all() and (end - start < line_chunks.LONGEST).all()
    pairs = {(s, s + 1) for s in range(399) if s != 199}
    assert pairs <= set(zip(start.tolist(), end.tolist())) and len(set((end - start).tolist())) > 3
    moved = line_chunks.runs(h[37:], doc[37:])
    later = start >= 39  # the first line there has lost the one before it
    assert set(key[later].tolist()) <= set(moved[0].tolist())
    monkeypatch.setattr(line_chunks, "runs", lambda h, doc: (h[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert not len(line_chunks.chunk_batch(pa.array(["a b\nc d\na b\nc d"]))[0])


def brute_lines(rows):
    """Texts without the lines of two successive ones (or of a long one) that stood before, in order of id."""
    words = lambda x: len(x.encode().split())
    seen, out = set(), {}
    for d, text in sorted(rows):
        lines = (text or "").split("\n")
        filled = [i for i, x in enumerate(lines) if words(x)]
        parts = [((lines[p], lines[q]), p, q) for p, q in zip(filled, filled[1:])] + [((lines[p],), p, p) for p in filled if words(lines[p]) >= line_chunks.LONG_LINE]
        gone = {i for key, p, q in sorted(parts, key=lambda x: x[1]) if key in seen or seen.add(key) for i in range(p, q + 1)}
        out[d] = None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_lines_against_brute_force(spark, docs):
    rng = np.random.default_rng(15)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    bag = [" ".join(f"s{rng.integers(40)}" for _ in range(int(rng.integers(0, 4)))) for _ in range(60)] + [" ".join(f"l{i}" for i in range(55))]
    rows += [(10_000 + i, "\n".join(bag[j] for j in rng.integers(0, len(bag), int(rng.integers(1, 25))))) for i in range(300)]
    got = {r["doc_id"]: r["text"] for r in line_chunks.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)


def test_short_passage_goes_from_all_documents_but_one(spark):
    """Five lines of 27 words in all, in fifty documents."""
    rng = np.random.default_rng(16)
    line = lambda n: " ".join(f"p{rng.integers(10**9)}" for _ in range(n))
    passage = [line(n) for n in (6, 5, 6, 5, 5)]
    rows = [(i, "\n".join([line(9), *passage, line(12)])) for i in range(50)]
    got = {r["doc_id"]: r["n_removed"] for r in line_chunks.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 5 if i else 0 for i in range(50)}


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    """All chunks under a few hashes: bytes decide, true repeats still go."""
    whole = line_chunks.chunks
    monkeypatch.setattr(line_chunks, "chunks", lambda *a: whole(*a).withColumn("h", F.col("h").bitwiseAND(F.lit(3))))
    monkeypatch.setattr(line_chunks, "BROADCAST_ROWS", 0)
    rows = [(i, f"a b\nc d\n{i} x\n{i} y") for i in range(4)] + [(9, "other\nlines\nhere")]
    got = {r["doc_id"]: r["text"] for r in line_chunks.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)


def brute_ppm(texts):
    """P(byte | context) by the definition, one byte at a time."""
    n = defaultdict(Counter)
    for t in texts:
        b = t.encode()
        for i in range(len(b)):
            for k in range(min(i, ppm_language.ORDER) + 1):
                n[b[i - k : i]][b[i]] += 1

    def p(context, s):
        lower = (lambda x: p(context[1:], x)) if context else (lambda x: 1 / 256)
        seen = n.get(context)
        if not seen:
            return lower(s)
        total, distinct = sum(seen.values()), len(seen)
        return seen[s] / (total + distinct) if s in seen else distinct / (total + distinct) * lower(s) / (1 - sum(map(lower, seen)))

    return p


def test_ppm_code_lengths_against_brute_force():
    samples = {"x": ["abcab cabba abc" * 2, "bca é中"], "y": ["zzab abz", "ccz ab"]}
    tests = ["abcabba", "zzz é中 q", "", "a", "Ω≈ abc", "", "\x00\xff"]
    m = ppm_language.PPM.fit({x: pa.array(v) for x, v in samples.items()})
    got = m.lengths(pa.array(tests))
    for i, x in enumerate(m.langs):
        p = brute_ppm(samples[x])
        for j, t in enumerate(tests):
            b = t.encode()
            assert got[j, i] == pytest.approx(sum(-np.log2(p(b[max(0, k - 4) : k], b[k])) for k in range(len(b))), rel=1e-4)
        for context in (b"", b"a", b"ab", b"cab", b"bcab", b"zz", b"\xe4\xb8"):
            assert sum(p(context, s) for s in range(256)) == pytest.approx(1)


def test_ppm_tells_eleven_scripts_and_alphabets_apart():
    """Small languages in scripts of their own, and neighbours that share one, from few texts."""
    rng = np.random.default_rng(17)
    letters = {"latin1": "abcdefgh", "latin2": "efghijkl", "accents": "éèêëàâùû", "greek": "αβγδεζηθ", "greek2": "ικλμνξοπ", "cyrillic": "абвгдежз", "cyrillic2": "ийклмноп", "hebrew": "אבגדהוזח", "arabic": "ابتثجحخد", "thai": "กขคงจฉชซ", "han": "中文字典語言學習"}
    text = lambda x, n: " ".join("".join(rng.choice(list(letters[x]), 5)) for _ in range(n))
    m = ppm_language.PPM.fit({x: pa.array([text(x, 40) for _ in range(5)]) for x in letters}, most_nodes=20_000)
    tests = [(x, text(x, 4)) for x in letters for _ in range(20)]
    pred = [m.langs[i] for i in m.lengths(pa.array([t for _, t in tests])).argmin(1)]
    assert sum(p == x for p, (x, _) in zip(pred, tests)) >= 0.98 * len(tests)


def test_language_held_out(spark, docs):
    got = ppm_language.language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)


def _enumerated(score, trans):
    """Log of the sum over all taggings of one chain, marginals and expected transitions."""
    n = len(score)
    z, tag, pair = 0.0, np.zeros(n), np.zeros((3, 2))
    for code in range(1 << n):
        y = [(code >> i) & 1 for i in range(n)]
        e = np.exp(trans[2, y[0]] + sum(trans[a, b] for a, b in zip(y, y[1:])) + sum(s for s, v in zip(score, y) if v))
        z += e
        tag += e * np.array(y)
        pair[2, y[0]] += e
        for a, b in zip(y, y[1:]):
            pair[a, b] += e
    return np.log(z), tag / z, pair / z


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(7)
    score, trans = rng.normal(size=12), rng.normal(size=(3, 2))
    first = np.zeros(12, bool)
    first[[0, 5, 6]] = True
    p, moves = crf_toxicity.forward_backward(score, first, trans)
    parts = [_enumerated(score[a:b], trans) for a, b in ((0, 5), (5, 6), (6, 12))]
    assert np.allclose(p, np.concatenate([x[1] for x in parts])) and np.allclose(moves, sum(x[2] for x in parts))


def test_gradients_against_differences():
    rng = np.random.default_rng(18)
    score, trans, tag = rng.normal(size=8), rng.normal(size=(3, 2)), rng.random(8) < 0.4
    first = np.zeros(8, bool)
    first[[0, 3]] = True

    def likelihood(s, t):
        total = 0.0
        for a, b in ((0, 3), (3, 8)):
            y = tag[a:b].astype(int)
            total += t[2, y[0]] + sum(t[i, j] for i, j in zip(y, y[1:])) + s[a:b][tag[a:b]].sum() - _enumerated(s[a:b], t)[0]
        return total

    gs, gt = crf_toxicity.gradients(score, first, tag, trans)
    for i in range(8):
        e = np.eye(8)[i] * 1e-5
        assert gs[i] == pytest.approx((likelihood(score + e, trans) - likelihood(score - e, trans)) / 2e-5, abs=1e-5)
    for i in range(6):
        e = np.eye(6)[i].reshape(3, 2) * 1e-5
        assert gt.ravel()[i] == pytest.approx((likelihood(score, trans + e) - likelihood(score, trans - e)) / 2e-5, abs=1e-5)


@pytest.mark.parametrize("n", [1, 31, 32, 33, 300, 5000])
def test_long_chains_step_by_step(n):
    """One line of any length is one chain: the block-wise scan against a plain loop."""
    rng = np.random.default_rng(n)
    score, trans = rng.normal(size=n) * 3, rng.normal(size=(3, 2))
    a, b = np.zeros((n, 2)), np.zeros((n, 2))
    for t in range(n):
        a[t] = trans[2] if not t else np.logaddexp(a[t - 1, 0] + trans[0], a[t - 1, 1] + trans[1])
        a[t, 1] += score[t]
    for t in range(n - 2, -1, -1):
        nxt = b[t + 1] + np.array([0, score[t + 1]])
        b[t] = [np.logaddexp(trans[i, 0] + nxt[0], trans[i, 1] + nxt[1]) for i in (0, 1)]
    want = np.exp(a[:, 1] + b[:, 1] - np.logaddexp(a[-1, 0], a[-1, 1]))
    p, moves = crf_toxicity.forward_backward(score, np.arange(n) == 0, trans)
    assert np.allclose(p, want, atol=1e-9) and moves.sum() == pytest.approx(n)


def test_document_scores_by_their_definition():
    w = crf_toxicity.Words(pa.array(["one two three", "", "four", None]), crf_toxicity.LETTER)
    p = np.array([0.2, 0.7, 0.1, 0.4])
    field = crf_toxicity.Field(np.zeros(crf_toxicity.TABLE), np.zeros((3, 2)), np.array([-1.0, 2.0, 0.5, -0.3]))
    got = field.document_scores(w, p)
    for d, (own, words) in enumerate([([0.2, 0.7, 0.1], 3), ([], 0), ([0.4], 1), ([], 0)]):
        high = max([*own, 1e-4])
        s = -1 + 2 * np.log(high / (1 - high)) / 4 + 0.5 * np.log1p(sum(own)) - 0.3 * np.log1p(words) / 4
        assert got[d] == pytest.approx(1 / (1 + np.exp(-s)))


def test_toxic_words_are_found_with_their_places(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(100)]
    rows, marks = [], []
    for i in range(400):
        w = [vocabulary[j] for j in rng.integers(0, 100, 30)]
        if i % 4 == 0:
            for p in rng.integers(0, 30, 2):
                w[p] = "scoundrel" if i % 8 else "nitwit"
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(i % 4 == 0), "", ""))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = crf_toxicity.toxicity(d, labels(spark, marks)).collect()
    wrong = sum(r["predicted"] != int(r["doc_id"] % 4 == 0) for r in got if r["held_out"])
    assert wrong <= 2
    texts = dict(rows)
    found = [texts[r["doc_id"]][s["start"] : s["end"]] for r in got for s in r["spans"]]
    assert found and set(found) <= {"scoundrel", "nitwit"}


def test_ordinal_tails_against_the_definition():
    """Features word by word, the latent quality their weighted sum, tails the logistic of its distance to each cut."""
    rng = np.random.default_rng(19)
    m = ordinal_quality.Ordinal(rng.normal(size=ordinal_quality.TABLE).astype(np.float32), np.array([-0.5, 0.3, 1.0]))
    texts = pa.array(["Some words, some more words.\nA 2nd line!", "", None, "x"])
    doc, place, value = ordinal_quality.features(texts)
    for d in range(4):
        s = sum(float(m.weight[i]) * v for k, i, v in zip(doc.tolist(), place.tolist(), value.tolist()) if k == d)
        assert m.tails(texts)[d] == pytest.approx([1 / (1 + np.exp(-(s - c))) for c in m.cuts])
    n = Counter(doc.tolist())
    assert [n[d] for d in range(4)] == [2 * 8 + 5, 5, 5, 2 + 5]  # a word and its shape each, and five steps


def test_ordinal_tails_are_ordered_and_grades_told_apart(spark):
    rng = np.random.default_rng(9)
    rows, marks = [], []
    for i in range(600):
        g = i % 3
        rows.append((i, " ".join((["junk%", "##"], ["plain", "so"], ["lovely", "prose"])[g][rng.integers(2)] if rng.random() < 0.4 else f"v{rng.integers(50)}" for _ in range(40))))
        marks.append((i, int(g > 0), int(g == 1), "", ""))
    got = ordinal_quality.quality(spark.createDataFrame(rows, "doc_id long, text string"), labels(spark, marks)).where("held_out").collect()
    assert all(r["p_ge_1"] >= r["p_ge_2"] for r in got)
    assert sum(round(r["expected_grade"]) == r["doc_id"] % 3 for r in got) >= 0.9 * len(got)


def test_components_of_a_chain(spark):
    star = [(1000, 1001 + i) for i in range(300)]
    e = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)] + star, "a long, b long")
    got = {r["v"]: r["component"] for r in common.connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, **{1000 + i: 1000 for i in range(301)}}


def test_scratch_folder_must_be_shared(spark):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        common.scratch_dir(Elsewhere)


def test_many_to_one_gives_each_row_once(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("k"), "id").unionByName(spark.range(3000).select(F.lit(99).cast("long").alias("k"), (F.col("id") + 10_000).alias("id")))
    ones = common.materialize(rows.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("low")))
    got = common.many_to_one(rows, ones, "k", "c").collect()
    low = {r["k"]: r["low"] for r in ones.collect()}
    assert len(got) == 8000 and all(r["low"] == low[r["k"]] for r in got)
