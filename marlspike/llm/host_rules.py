"""Quality rules judged by host (operator 8).

Every document gets plain counts; rules on them fail or pass. Failures are
added up by host, each host's failure rate is shrunk towards the rate of all
hosts by a beta prior fitted to the hosts themselves (method of moments), and a
host whose shrunken rate of any rule reaches ``max_rate`` is rejected with all
its documents.

Defined cases: a null or empty text has no words and fails ``few_words``; a text
of any length is counted whole; a null host is a host of its own; a host whose
rate ties with ``max_rate`` is rejected; repeated rows are judged each by
itself; an empty table gives an empty result. Only the named columns are read,
so extra columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import handle, many_to_one, materialize, small_batches
from .textnum import Words, pieces

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
WINDOW = 5

def rules() -> dict[str, Column]:
    return {
        "few_words": F.col("n_words") < 10,
        "repeats": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "dup_lines": 20 * F.col("n_dup_lines") > F.col("n_words"),
    }


def _repeat_words(words: list[bytes]) -> int:
    """Words inside a 5-word window that occurs twice or more, the first occurrence included."""
    where: dict[tuple, int] = {}
    covered = bytearray(len(words))
    for i, g in enumerate(zip(*(words[j:] for j in range(WINDOW)))):
        first = where.setdefault(g, i)
        if first != i:
            covered[first : first + WINDOW] = covered[i : i + WINDOW] = b"\x01" * WINDOW
    return sum(covered)


def _dup_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(b" \t\n\r\x0b\x0c"):
            seen.add(line)
    return n


def count_batch(texts: pa.Array) -> list[np.ndarray]:
    """The five counts of each text."""
    w = Words(texts)
    chars = w.per_doc(w.inside & ((w.data & 0xC0) != 0x80))
    symbols = w.per_doc(_SYMBOL[w.data])
    dup, repeat = np.zeros(w.n, np.int64), np.zeros(w.n, np.int64)
    raw = w.data.tobytes()
    lines = w.per_doc(w.data == 10)
    for d in np.flatnonzero(lines):
        dup[d] = _dup_lines(raw[w.offsets[d] : w.offsets[d + 1]])
    g, at = w.grams(w.hashes(lower=False), WINDOW)
    if len(g):
        with np.errstate(over="ignore"):
            own = g ^ (w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        s = np.sort(own)
        twice = s[1:][s[1:] == s[:-1]]
        if len(twice):  # equal hashes only choose the texts that are counted word by word
            for d in np.unique(w.doc[at[np.isin(own, twice)]]):
                repeat[d] = _repeat_words(raw[w.offsets[d] : w.offsets[d + 1]].split())
    return [w.count.astype(np.int64), chars, symbols, dup, repeat]


def document_counts(docs: DataFrame, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``keep`` columns and the five counts of each whole text; n_words counts ``[^\\x20\\x09-\\x0D]+``."""
    small_batches(docs.sparkSession)
    rows = docs.select(*(keep or []), F.col(text).alias("_text"))
    schema = rows.drop("_text").schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    kept = rows.columns[:-1]

    def run(batches):
        for b in pieces(batches, "_text"):
            cols = [b.column(i) for i in range(len(kept))] + [pa.array(x) for x in count_batch(b.column(len(kept)))]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, *COUNTS])

    return rows.mapInArrow(run, schema)


def host_verdicts(stats: DataFrame, host: str, max_rate: float = 0.5) -> DataFrame:
    """One row per host: documents, failures and shrunken rate of each rule, host_kept."""
    names = list(rules())
    hosts = stats.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.col(f"fails_{r}").cast("long")).alias(f"n_{r}") for r in names])
    aggs = [F.avg(1.0 / F.col("n_docs")).alias("inv"), F.sum("n_docs").alias("n")]
    for r in names:
        rate = F.col(f"n_{r}") / F.col("n_docs")
        aggs += [F.sum(f"n_{r}").alias(f"f_{r}"), F.var_pop(rate).alias(f"v_{r}")]
    prior = hosts.agg(*aggs).first()  # one row, whatever the number of hosts
    out, ok = hosts, F.lit(True)
    for r in names:
        mean = (prior[f"f_{r}"] or 0) / prior["n"] if prior["n"] else 0.0
        spread = mean * (1 - mean)
        between = max((prior[f"v_{r}"] or 0.0) - spread * (prior["inv"] or 0.0), spread / 1e6)
        strength = min(max(spread / between - 1, 2.0), 1e6) if between > 0 else 1e6
        out = out.withColumn(f"rate_{r}", (F.col(f"n_{r}") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength)))
        ok = ok & (F.col(f"rate_{r}") < max_rate)
    return out.withColumn("host_kept", ok)


def judge(docs: DataFrame, host: Column | None = None, doc_id: str = "doc_id", text: str = "text", max_rate: float = 0.5) -> DataFrame:
    """doc_id, _at (a handle), the counts, base_failed, host_kept and kept of every document."""
    host = F.col("source") if host is None else host
    keep = [F.col(doc_id).alias("doc_id"), handle(doc_id, text).alias("_at"), F.concat(F.lit("h"), host.cast("string")).alias("_host")]
    stats = document_counts(docs, text, keep).withColumn("_host", F.coalesce("_host", F.lit("-")))
    stats = materialize(stats, "counts")
    for r, failed in rules().items():
        stats = stats.withColumn(f"fails_{r}", failed)
    verdicts = materialize(host_verdicts(stats, "_host", max_rate).select("_host", "n_docs", "host_kept"), "verdicts")
    out = many_to_one(stats, verdicts, "_host", "n_docs")
    base = F.col("fails_few_words") | F.col("fails_repeats")
    return out.select("doc_id", "_at", *COUNTS, base.alias("base_failed"), F.col("host_kept"), (~base & F.col("host_kept")).alias("kept"))


def oracle(max_rate: float = 0.5) -> str:
    """The same counts and verdicts by plain SQL."""
    fails = {"few_words": "n_words < 10", "repeats": "100 * n_repeat_words > 20 * n_words", "symbols": "10 * n_symbols > word_chars", "dup_lines": "20 * n_dup_lines > n_words"}
    sums = ", ".join(f"sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS n_{r}" for r, c in fails.items())
    prior = ", ".join(f"sum(n_{r}) / sum(n_docs)::DOUBLE AS m_{r}, var_pop(n_{r} / n_docs::DOUBLE) AS v_{r}" for r in fails)
    between = ", ".join(f"greatest(v_{r} - m_{r} * (1 - m_{r}) * inv, m_{r} * (1 - m_{r}) / 1e6) AS b_{r}" for r in fails)
    strength = ", ".join(f"CASE WHEN b_{r} > 0 THEN least(greatest(m_{r} * (1 - m_{r}) / b_{r} - 1, 2), 1e6) ELSE 1e6 END AS s_{r}" for r in fails)
    ok = " AND ".join(f"(n_{r} + m_{r} * s_{r}) / (n_docs + s_{r}) < {max_rate}" for r in fails)
    return f"""WITH t AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
lines AS (SELECT k, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY k),
grams AS (SELECT k, i, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM (SELECT k, w, unnest(range(len(w) - 4)) AS i FROM t WHERE len(w) >= 5)),
twice AS (SELECT k, g FROM grams GROUP BY k, g HAVING count(*) > 1),
covered AS (SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM grams JOIN twice USING (k, g), range(5) r(j) GROUP BY k),
counts AS (SELECT k, doc_id, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM t LEFT JOIN lines USING (k) LEFT JOIN covered USING (k)),
hosts AS (SELECT source, count(*) AS n_docs, {sums} FROM counts GROUP BY source), prior AS (SELECT avg(1.0::DOUBLE / n_docs) AS inv, {prior} FROM hosts), between0 AS (SELECT *, {between} FROM prior), strength AS (SELECT *, {strength} FROM between0),
verdict AS (SELECT source, {ok} AS host_kept FROM hosts, strength)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND host_kept AS kept
FROM counts JOIN verdict ON counts.source IS NOT DISTINCT FROM verdict.source"""
