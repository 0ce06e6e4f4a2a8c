"""Mixing sources to target weights by systematic sampling (operator 7).

Every document of a source expects equally many copies: its source's target over
its source's size. Within a source documents stand in a fixed order; expected
copies are summed up in that order, one random offset per source is added, and a
document is emitted once for every whole number that its stretch crosses. So
each gets its expected copies rounded down or up.

Documents are ranked by size, the largest first, and dealt into hands like
cards; the order is that of the hands, one after another, of the first rank of
each on. The offset is (k + u) / ``OFFSETS`` with u from the md5 of seed and
source. Of the numbers of hands in ``HANDS`` and the values of k those are taken
that bring the source's words nearest to its target (the first of two alike).
All of them are tried in one aggregation over the documents. With one hand sizes
only fall along the order, so the words taken differ from the target by less
than the source's largest document; the best differs by no more.

Copies are counted in whole units of 1e-8, so sums are exact in any order.

Defined cases: a null text has size 0; a text of any length is one document;
null is a source of its own, placed last; a source without words has target 0
and takes nothing; documents of equal size are ordered by doc_id, nulls last,
and handle; rows that are repeated are documents of their own; an empty table
gives an empty result. Only the named columns are read, so extra columns can't
clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, handle, many_to_one, materialize, prefix_sum, range_sorted

UNITS = 100_000_000
CAP = 3.0
#: Numbers of hands, and evenly spaced offsets, that are tried for a source.
HANDS, OFFSETS = (1, 2, 3, 5, 7), 8


def targets(sizes: DataFrame, cap: float = CAP, cycle: int = 3) -> DataFrame:
    """(_source, source_size, n_docs, target) for ``sizes(_source, size)``; a written table.

    Sources in code-point order, null last, weigh 1..cycle, repeating. The
    shared level is found in closed form: with sources ordered by the level at
    which they fill up, the first k full ones leave (all - their caps) to the
    others' weights. Ranks and sums run over ranges of sources, however many
    sources there are.
    """
    per = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = [F.col("_source").asc_nulls_last()]
    per = prefix_sum(range_sorted(per, order, "sources"), [], order, F.lit(1).cast("long"), "_nth").drop("_pid")
    per = per.withColumn("weight", ((F.col("_nth") - 1) % cycle + 1).cast("long")).withColumn("_cap", F.floor(cap * F.col("source_size")).cast("long"))
    order = [F.col("_full"), F.col("_source").asc_nulls_last()]
    levels = range_sorted(per.withColumn("_full", F.col("_cap") / F.col("weight")), order, "levels")
    levels = prefix_sum(levels, [], order, F.col("_cap"), "_caps")
    levels = materialize(prefix_sum(levels, [], order, F.col("weight"), "_weights"), "filled")
    every = levels.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(every["size"] or 0) - (F.col("_caps") - F.col("_cap"))) / (F.lit(every["weight"] or 0) - (F.col("_weights") - F.col("weight")))
    first = levels.withColumn("_level", level).where("_full >= _level").agg(F.min(F.struct("_full", "_weights", "_level")).alias("x")).select("x._level").first()
    shared = F.lit(float(first[0]) if first and first[0] is not None else 0.0)
    return materialize(levels.select("_source", "source_size", "n_docs", F.least(F.col("_cap").cast("double"), shared * F.col("weight")).alias("target")), "targets")


def random_bits(source: Column, seed: str) -> Column:
    """20 bits by the md5 of seed and source."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(source, F.lit("-"))).cast("binary")), 1, 5)
    return F.conv(digits, 16, 10).cast("long")


def offset_units(k: Column, bits: Column) -> Column:
    """(k + bits / 2^20) / OFFSETS in whole units."""
    return ((k * 1048576 + bits) * UNITS / (1048576 * OFFSETS)).cast("long")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "7", cap: float = CAP) -> DataFrame:
    """doc_id, _at (a handle), source, size, source_size, target, copies and taken of every document."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    # counted once: the range sampler below reads the written sizes, not the texts
    sizes = materialize(docs.select(F.col(doc_id).alias("doc_id"), handle(doc_id, text).alias("_at"), F.col(source).alias("_source"), size.alias("size")), "sizes")
    order = [F.col("size").desc(), F.col("doc_id").asc_nulls_last(), F.col("_at").asc()]
    ranged = range_sorted(sizes, [F.col("_source").asc_nulls_last(), *order], "sizes")
    ranked = materialize(prefix_sum(ranged, ["_source"], order, F.lit(1).cast("long"), "_rank").drop("_pid"), "ranked")
    key = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("-"))
    expect = F.least(F.coalesce(F.round(F.try_divide("target", F.col("source_size").cast("double")) * UNITS), F.lit(0.0)), F.lit(cap * UNITS)).cast("long")
    goal = targets(sizes, cap).withColumnRenamed("_source", "_src").withColumn("_key", key(F.col("_src"))).withColumn("_expect", expect).withColumn("_bits", random_bits(F.col("_src"), seed)).withColumn("_n", F.col("n_docs")).drop("_src")
    goal = materialize(goal, "goal")
    keyed = ranked.withColumn("_key", key(F.col("_source")))
    rows = many_to_one(keyed, goal, "_key", "n_docs")
    ways = [(m, k) for m in HANDS for k in range(OFFSETS)]
    tried = rows.groupBy("_key", "target").agg(*[F.sum(F.col("size") * _copies(_place(F.lit(m)), offset_units(F.lit(k), F.col("_bits")))).alias(f"_t{m}_{k}") for m, k in ways])
    off = F.array_min(F.array(*[F.struct(F.abs(F.col(f"_t{m}_{k}") - F.col("target")).alias("off"), F.lit(m).cast("long").alias("m"), F.lit(k).cast("long").alias("k")) for m, k in ways]))
    best = tried.select("_key", off.alias("b")).select("_key", F.col("b.m").alias("_m"), F.col("b.k").alias("_k"))
    goal = materialize(goal.join(best, "_key").withColumn("_offset", offset_units(F.col("_k"), F.col("_bits"))), "ways")
    rows = many_to_one(keyed, goal, "_key", "n_docs").withColumn("copies", _copies(_place(F.col("_m")), F.col("_offset")))
    return rows.select("doc_id", "_at", F.col("_source").alias("source"), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _place(hands: Column) -> Column:
    """Place, from 1, of the document of rank ``_rank`` of ``_n`` in the order of so many hands."""
    nth = F.col("_rank") - 1
    hand = nth % hands
    return hand * F.call_function("div", F.col("_n"), hands) + F.least(hand, F.col("_n") % hands) + F.call_function("div", nth, hands) + 1


def _copies(place: Column, offset: Column) -> Column:
    """Whole numbers that the stretch of the document at ``place`` crosses."""
    return _upto(place, offset) - _upto(place - 1, offset)


def _upto(rank: Column, offset: Column) -> Column:
    """Whole numbers below or at rank * _expect + offset units, in parts that no count of rows overflows."""
    whole = lambda a, b: F.call_function("div", a, F.lit(b))
    high, low = whole(F.col("_expect"), UNITS), F.col("_expect") % UNITS
    return rank * high + whole(rank, UNITS) * low + whole((rank % UNITS) * low + offset, UNITS)


def oracle(seed: str = "7", cap: float = CAP, cycle: int = 3) -> str:
    """The same mix by plain SQL."""
    return f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {cycle} + 1 AS weight FROM d GROUP BY source),
full0 AS (SELECT *, floor({cap}::DOUBLE * source_size) AS cap, floor({cap}::DOUBLE * source_size) / weight AS fills FROM per),
levels AS (SELECT *, row_number() OVER w AS nth, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY fills, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY fills, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM full0 WINDOW w AS (ORDER BY fills, source NULLS LAST)),
goal AS MATERIALIZED (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, nth) FROM levels WHERE fills >= level), 0) * weight) AS target FROM levels),
units AS MATERIALIZED (SELECT *, least(coalesce(round(target / CASE WHEN source_size > 0 THEN source_size::DOUBLE END * {UNITS}), 0), {cap} * {UNITS})::BIGINT AS expect, ('0x' || substr(md5('{seed}|' || coalesce(source, '-')), 1, 5))::BIGINT AS bits FROM goal),
ranked AS MATERIALIZED (SELECT d.*, source_size, target, expect, bits, row_number() OVER (PARTITION BY d.source ORDER BY size DESC, doc_id NULLS LAST) AS r FROM d JOIN units ON d.source IS NOT DISTINCT FROM units.source),
tried AS (SELECT *, ((k * 1048576 + bits) * {UNITS}) // {1048576 * OFFSETS} AS start, ((r - 1) % m) * (n // m) + least((r - 1) % m, n % m) + (r - 1) // m + 1 AS p FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM ranked), range({OFFSETS}) o(k), (SELECT unnest({list(HANDS)}) AS m)),
copied AS (SELECT *, (p::HUGEINT * expect + start) // {UNITS} - ((p - 1)::HUGEINT * expect + start) // {UNITS} AS copies FROM tried),
best AS (SELECT source, min({{'off': off, 'm': m, 'k': k}}) AS b FROM (SELECT source, m, k, abs(sum(size * copies)::DOUBLE - any_value(target)) AS off FROM copied GROUP BY source, m, k) GROUP BY source)
SELECT c.doc_id, c.size, c.source_size, c.target, (c.size * c.copies)::BIGINT AS taken FROM copied c JOIN best ON c.source IS NOT DISTINCT FROM best.source AND c.k = best.b.k AND c.m = best.b.m"""
