"""Conversation repair against an exhaustive search, and its segments against whole conversations."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from marlspike.llm import turn_grammar
from marlspike.llm.queries import op12_turn_grammar

GRAMMAR = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, _rid string, cost int, audit int, node string"


def after_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        conv_text, turn_text = (" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        d = zlib.crc32(f"{conv_text}:{turn_text}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out[conv] += [(turn, "user" if d == 4 else role, text)] * (1 + (d == 3))
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(turn_grammar.BLANKS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) over states, one turn after another, with whole audits compared."""
    found = faults_of(rows)
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    full = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, made) in list(best.items()):
                for r in "ua":
                    if (state, r) in step:
                        new = (cost + 5, audit + "I", (*made, (full[r], "")))
                        to = step[state, r]
                        best[to] = min(best.get(to, new), new)
        return best

    best = {0: (0, "", ())}
    for (_, role, text), fault in zip(rows, found):
        now = {}
        more = 5 * (fault == "truncated")
        for state, (cost, audit, made) in inserted(best).items():
            options = [(state, cost + 2, audit + "D", made)]
            if fault not in ("blank", "duplicate"):
                if (state, role[:1]) in step:
                    options.append((step[state, role[:1]], cost + more, audit + "K", (*made, (role, text))))
                options += [(step[state, r], cost + 1 + more, audit + "R", (*made, (full[r], text))) for r in "ua" if (state, r) in step]
            for to, *new in options:
                now[to] = min(now.get(to, tuple(new)), tuple(new))
        best = now
    return min(x for s, x in inserted(best).items() if s in (0, 3))


def expected(rows):
    held = after_damage(rows)
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(held.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        found = faults_of(own)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, made = cheapest(own)
        out[conv] = (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    return out


def found(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_query_against_plain_version(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = op12_turn_grammar(spark, sf_dir)
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = found(df)
    assert got == expected(rows)
    assert any("D" in x[6] for x in got.values()) and any("R" in x[6] for x in got.values())


def made_up(rng, convs, longest):
    rows = []
    for c in range(convs):
        for t in range(int(rng.integers(0, longest))):
            role = ["user", "assistant", "system", None, "tool", ""][int(rng.choice(6, p=[0.4, 0.35, 0.1, 0.05, 0.05, 0.05]))]
            text = [None, "", " \t", "yes.", "no", "ha! ", f"word {t}.", f"word {t}", "é?", "many words " * 30 + "."][int(rng.integers(0, 10))]
            rows.append((c if c else None, t if rng.random() < 0.95 else None if longest < 20 else t, role, text, "clash", 1, 2, "x"))
    return rows


@pytest.mark.parametrize("segment", [3, 64])
def test_short_and_long_conversations(spark, monkeypatch, segment):
    monkeypatch.setattr(turn_grammar, "SEGMENT", segment)
    rng = np.random.default_rng(segment)
    rows = made_up(rng, 60, 9) if segment > 3 else []
    rows = [r for r in rows if r[1] is not None] + [(100 + c, *r[1:]) for c in range(3) for r in made_up(rng, 2, 90) if r[0] == 1]
    rng.shuffle(rows)
    rows = [tuple(None if v is None else int(v) if i in (0, 1, 5, 6) else v for i, v in enumerate(r)) for r in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(turn_grammar.repair(df, damage=True)) == expected(rows)


def test_hot_conversation_of_repeats(spark):
    rows = [(7, t, ["user", "assistant"][t % 2], "the same." if t % 3 else f"turn {t}.", "c", 1, 2, "x") for t in range(700)]
    rows += [(8, 1, "user", "hello.", "c", 1, 2, "x"), (9, None, None, None, "c", 1, 2, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(turn_grammar.repair(df, damage=True)) == expected(rows)


def test_undamaged_repeated_and_empty(spark):
    rows = [(1, 1, "user", "a.", "c", 1, 2, "x"), (1, 1, "user", "a.", "c", 1, 2, "x"), (1, 2, "assistant", "b.", "c", 1, 2, "x"), (2, 5, "assistant", "b", "c", 1, 2, "x")]
    got = found(turn_grammar.repair(spark.createDataFrame(rows, SCHEMA)))
    assert got[1][:7] == (0, 0, 1, 0, 1, 2, "KDK") and got[2][:7] == (0, 0, 0, 1, 0, 2, "D")
    assert turn_grammar.repair(spark.createDataFrame([], SCHEMA), damage=True).collect() == []


def test_transitions_reach_every_repair():
    """All edit strings of up to three turns with inserts anywhere: none is cheaper, or as cheap and less."""
    step = {(0, "s"): 1, **{k: v for k, v in turn_grammar.KEEP.items()}}
    for initials in itertools.product("sua", repeat=2):
        want = None
        for edits in itertools.product(["", "I", "II"], ["D", "K", "R"], ["", "I", "II"], ["D", "K", "R"], ["", "I", "II"]):
            audit = "".join(edits)
            paths, cost = {0}, 0
            turns = iter(initials)
            for e in audit:
                own = next(turns) if e != "I" else None
                cost += {"D": 2, "K": 0, "R": 1, "I": 5}[e]
                if e == "K":
                    paths = {step[s, own] for s in paths if (s, own) in step}
                elif e != "D":
                    paths = {step[s, r] for s in paths for r in "ua" if (s, r) in step}
            if paths & {0, 3}:
                want = min(want or (99, ""), (cost, audit))
        rows = [(k, {"s": "system", "u": "user", "a": "assistant"}[i], f"t{k}.") for k, i in enumerate(initials)]
        assert cheapest(rows)[:2] == want
