"""Line dedup by content-defined chunks of lines (operator 9).

A rolling hash over the last ``WINDOW`` line hashes decides by one bit where a
chunk ends, so boundaries move with the content and not with its place. There
are two complementary sets of boundaries, one at set and one at unset bits.
Chunks are the stretches between successive boundaries of a set (of up to
``LONGEST`` lines that aren't blank), and what runs from any line to the nearest
boundary after it, of whichever set. A line's bit depends on it and the line
before alone, so of any two successive lines the second is a boundary of one
set, wherever they stand: every line of a repeated run of two lines or more,
however short the lines, lies in a repeated chunk, and longer runs also in
longer chunks. (Any boundaries that find all repeated runs of two lines remove
the same lines; the hash decides which chunks are compared.) A paragraph that
is a single line of ``long_line`` words or more is a chunk of its own, since a
passage may be one line; shorter single lines (titles, licenses) are left
alone, and None leaves all single lines alone.

Chunks are counted by hash over all documents. Chunks whose hash repeats are
cut out of their texts and grouped by their bytes (without blank lines), so
that what counts as repeated is equal byte by byte. The first occurrence (by
doc_id, then place) stays, the lines of all others go.

Defined cases: a null text stays null, an empty one empty; a text of any length
is one document; blank lines end no run and start none, and go where they stand
within a chunk; copies of a whole document lose all their repeated lines;
rows repeated with the same doc_id and text are one document and keep the same
lines; a null doc_id comes after all others, equal places are ordered by the
handle; an empty table gives an empty result. Only the named columns are read,
so extra columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import handle, many_to_one, materialize, small_batches
from .textnum import U, Words, mix, pieces, powers

WINDOW = 2
LONGEST = 16
LONG_LINE = 50
#: Lists up to this many chunks or marks (of 8 to 40 bytes each) are broadcast, longer ones joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def chunk_batch(texts: pa.Array, long_line: int | None = LONG_LINE) -> tuple[np.ndarray, ...]:
    """(document, hash, first line, lines) of every chunk, ordered by document."""
    w = Words(texts)
    ends = np.flatnonzero(w.data == 10)
    full = np.flatnonzero(np.diff(w.offsets))
    # a line stops at its line end or with its text; one that ends with a line end has an empty last line
    stop, doc = np.concatenate([ends, w.offsets[full + 1]]), np.concatenate([np.searchsorted(w.offsets, ends, "right") - 1, full])
    order = np.lexsort((stop, doc))
    stop, doc = stop[order], doc[order]
    is_last = np.zeros(len(stop), bool)
    if len(stop):
        is_last[:-1] = doc[1:] != doc[:-1]
        is_last[-1] = True
    first = np.ones(len(stop), bool)
    first[1:] = is_last[:-1]
    begin = np.where(first, w.offsets[doc], np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop)
    h = w.span_hash(begin, stop, lower=False)
    words = np.searchsorted(w.start, stop) - np.searchsorted(w.start, begin)
    line = np.arange(len(stop)) - np.maximum.accumulate(np.where(first, np.arange(len(stop)), 0))
    alone = np.flatnonzero(words >= long_line) if long_line else np.zeros(0, np.int64)
    out = [(doc[alone], mix(h[alone] + U(9)), line[alone], np.ones(len(alone), np.int64))]
    filled = np.flatnonzero(words > 0)
    key, start, end = runs(h[filled], doc[filled])
    out.append((doc[filled][start], key, line[filled][start], filled[end] - filled[start] + 1))
    cols = [np.concatenate(c) for c in zip(*out)]
    order = np.argsort(cols[0], kind="stable")
    return tuple(c[order] for c in cols)


def boundary_bits(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """One bit of a rolling hash over each line and the ``WINDOW`` - 1 before it in its text."""
    with np.errstate(over="ignore"):
        roll = mix(h + U(1))
        for back in range(1, WINDOW):
            same = np.zeros(len(h), bool)
            same[back:] = doc[back:] == doc[: len(h) - back]
            roll[back:] += np.where(same[back:], mix(h[: len(h) - back] + U(back + 1)), U(0))
        return (mix(roll) >> U(17)) & U(1)


def runs(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, last) of the chunks of lines with hashes ``h``, by place among these lines; the key depends on the chunk's hashes alone."""
    n = len(h)
    if not n:
        return h, np.zeros(0, np.int64), np.zeros(0, np.int64)
    bit, place = boundary_bits(h, doc), np.arange(n)
    last = np.searchsorted(doc, doc, "right") - 1  # of the text
    new = np.append(True, doc[1:] != doc[:-1])
    start, end = [], []
    for family in (0, 1):
        cut = bit == U(family)
        at = np.minimum.accumulate(np.where(cut, place, n)[::-1])[::-1]
        stop = np.minimum(np.minimum(np.append(at[1:], n), last), place + LONGEST - 1)
        after = new | np.append(True, cut[:-1])  # the set's own stretches begin here
        take = (stop > place) & (after | (stop == place + 1))
        start.append(place[take])
        end.append(stop[take])
    whole = np.unique(np.stack([np.concatenate(start), np.concatenate(end)]), axis=1)
    start, end = [whole[0]], [whole[1]]
    start, end = np.concatenate(start), np.concatenate(end)
    power, inverse = powers(n + 1)
    with np.errstate(over="ignore"):
        upto = np.zeros(n + 1, U)
        np.cumsum(mix(h + U(21)) * power[:n], dtype=U, out=upto[1:])
        return mix((upto[end + 1] - upto[start]) * inverse[start] ^ mix((end - start).astype(U))), start, end


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col("_at"), F.col("start"))


def _cut_lines(text: str, marks: list[dict]) -> tuple[str, int]:
    """The text without the marked lines, and how many these are."""
    lines = text.split("\n")
    gone = {i for m in marks for i in range(m["start"], m["start"] + m["n"])}
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", long_line: int | None = LONG_LINE) -> DataFrame:
    """(doc_id, _at, h, start, n) of every chunk of every document (a written table)."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), handle(doc_id, text).alias("_at"))

    def split(batches):
        for b in pieces(batches):
            doc, h, start, n = chunk_batch(b.column(1), long_line)
            off = np.searchsorted(doc, np.arange(b.num_rows + 1))
            structs = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["h", "start", "n"])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.ListArray.from_arrays(pa.array(off, pa.int32()), structs)], names=["doc_id", "_at", "chunks"])

    found = base.mapInArrow(split, "doc_id long, _at struct<a:long,b:long>, chunks array<struct<h:long,start:int,n:int>>")
    return materialize(found.where(F.size("chunks") > 0), "chunks").select("doc_id", "_at", F.explode("chunks").alias("c")).select("doc_id", "_at", "c.*")


def _bodies(texts: DataFrame) -> DataFrame:
    """(doc_id, _at, h, start, n, body) of the ``marks`` of rows with their texts; a body has no blank lines."""

    def run(batches):
        for b in pieces(batches):
            row, out = [], []
            for i, (body, marks) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                lines = body.encode().split(b"\n")
                row += [i] * len(marks)
                out += [(m["h"], m["start"], m["n"], b"\n".join(x for x in lines[m["start"] : m["start"] + m["n"]] if x.split())) for m in marks]
            for s in range(0, len(out), 20_000):
                own = pa.array(row[s : s + 20_000])
                cols = [pa.array(c, t) for c, t in zip(zip(*out[s : s + 20_000]), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), *cols], names=["doc_id", "_at", "h", "start", "n", "body"])

    return texts.select("doc_id", "_at", "text", "marks").mapInArrow(run, "doc_id long, _at struct<a:long,b:long>, h long, start int, n int, body binary")


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", long_line: int | None = LONG_LINE) -> tuple[DataFrame, int]:
    """(_at, start, n) of every chunk that is equal byte by byte to one before it, and how many rows these are at most."""
    every = chunks(docs, doc_id, text, long_line)
    repeated = materialize(every.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "repeated")
    n_repeated = repeated.count()
    if n_repeated <= BROADCAST_ROWS:
        found = every.join(F.broadcast(repeated.select("h")), "h", "left_semi")
    else:
        found = many_to_one(every, repeated, "h", "c")
    found = materialize(found.distinct(), "found")
    n_found = found.count()
    listed = found.groupBy("_at").agg(F.collect_list(F.struct("h", "start", "n")).alias("marks"))  # a document's own chunks
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), handle(doc_id, text).alias("_at"))
    cut = _bodies(base.join(_small(listed, n_found), "_at"))
    digest = F.struct(F.xxhash64("body").alias("a"), F.xxhash64(F.lit("body"), "body").alias("b"))  # names a body that was compared
    alike = materialize(cut.groupBy("h", "body").agg(F.min(_place()).alias("origin")).select("h", digest.alias("body"), "origin"), "alike")
    by_hash = alike.groupBy("h").agg(F.count(F.lit(1)).alias("bodies"), F.min("origin").alias("origin"))
    one = by_hash.where("bodies = 1").select("h", "origin")
    if n_repeated <= BROADCAST_ROWS:
        again = found.join(F.broadcast(one), "h")
    else:
        again = many_to_one(found, materialize(one.join(repeated, "h"), "one-body"), "h", "c")
    later = (F.col("_at") != F.col("origin._at")) | (F.col("start") != F.col("origin.start"))
    out = again.where(later).select("_at", "start", "n")
    several = by_hash.where("bodies > 1").select("h")
    if several.limit(1).count():  # a hash of unlike chunks: each occurrence goes by its own body
        own = _bodies(base.join(found.join(several, "h").groupBy("_at").agg(F.collect_list(F.struct("h", "start", "n")).alias("marks")), "_at"))
        own = own.withColumn("body", digest).join(alike, ["h", "body"]).where(later)
        out = out.unionByName(own.select("_at", "start", "n"))
    return out, n_found


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", long_line: int | None = LONG_LINE) -> DataFrame:
    """doc_id, n_lines, n_removed and the remaining text of every document."""
    again, most = repeats(docs, doc_id, text, long_line)
    marks = again.groupBy("_at").agg(F.collect_set(F.struct("start", "n")).alias("marks"))
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), handle(doc_id, text).alias("_at"))
    rows = base.join(_small(marks, most), "_at", "left").select("doc_id", "text", "marks")

    def remove(batches):
        for b in pieces(batches):
            body, counts, gone = [], [], []
            for x, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                counts.append(x.count("\n") + 1 if x else 0)
                left, n = _cut_lines(x, m) if x and m else (x, 0)
                body.append(left)
                gone.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int32()), pa.array(gone, pa.int32()), pa.array(body, pa.string())], names=["doc_id", "n_lines", "n_removed", "text"])

    return rows.mapInArrow(remove, "doc_id long, n_lines int, n_removed int, text string")
