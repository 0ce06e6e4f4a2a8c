"""Bounded training samples: rows chosen by a hash, so that a run repeats its choice."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text of each value that a sample holds at most (about).
MOST_BYTES = 8 << 20
#: A text of more bytes is learned from in this many pieces of so many characters, spread evenly over it from its first to its last.
LONGEST, PIECES, PIECE = 1 << 18, 8, 8192


def spread(text: Column) -> Column:
    """``text``, or its pieces, one a line, where it is very long."""
    step = (F.length(text) - PIECE) / (PIECES - 1)
    cut = [F.substring(text, (1 + F.floor(step * k)).cast("int"), F.lit(PIECE)) for k in range(PIECES)]
    return F.when(F.octet_length(text) > LONGEST, F.concat_ws("\n", *cut)).otherwise(text)


def bounded(rows: DataFrame, by: str, most: dict | int, key: str = "doc_id", text: str | None = None, most_bytes: int = MOST_BYTES) -> pa.Table:
    """About ``most`` rows (one number, or one for each value) of each value of ``by``, as an Arrow table.

    With ``text`` also about ``most_bytes`` bytes of it at most, whatever the number of values. Counts and sizes
    of each value give the share to take; no row is moved to choose it.
    """
    rows = rows.where(F.col(by).isNotNull())
    if text is not None:
        rows = rows.withColumn(text, spread(F.col(text)))
    size = F.lit(0) if text is None else F.coalesce(F.octet_length(text), F.lit(0))
    found = {r[0]: (r["n"], r["size"]) for r in rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size")).collect()}
    share = F.lit(0.0)
    for value, (n, held) in found.items():
        m = most.get(value, 0) if isinstance(most, dict) else most
        share = F.when(F.col(by) == value, F.lit(min(1.0, m / n, most_bytes / max(held, 1)))).otherwise(share)
    place = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    if not found:
        return rows.limit(0).toArrow()
    return rows.where(place < share).toArrow().combine_chunks().sort_by(key)


def labelled_texts(docs: DataFrame, marks: DataFrame, by: str, most: dict | int, doc_id: str = "doc_id", text: str = "text") -> pa.Table:
    """(doc_id, text, ``by``) of a bounded sample of ``marks(doc_id, by)``, ordered by doc_id.

    The marks are sampled first, so that their broadcast is bounded; the texts' bytes are bounded after the join."""
    marks = marks.select(F.col("doc_id").alias("_l"), F.col(by).alias(by))
    chosen = bounded(marks, by, most, "_l")
    kinds = f"_l {dict(marks.dtypes)['_l']}, {by} {dict(marks.dtypes)[by]}"
    few = docs.sparkSession.createDataFrame(list(zip(chosen["_l"].to_pylist(), chosen[by].to_pylist())), kinds)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(few), F.col("doc_id") == F.col("_l")).drop("_l")  # at most sum(most) marks
    return bounded(texts, by, max(chosen.num_rows, 1), "doc_id", "text").sort_by([("doc_id", "ascending"), (by, "ascending")])
