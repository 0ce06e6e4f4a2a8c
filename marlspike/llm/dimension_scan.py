"""Approximate nearest neighbours by adaptive dimension scan (operator 11).

Vectors are scaled to length one, rotated by a random orthogonal matrix and kept
in lists around centroids, each list in chunks. A query is first compared with
the list of its own nearest centroid, which gives it a bound: the distance of
its k-th nearest so far. Then it scans the other lists that it probes, block of
columns after block of columns, and abandons a candidate as soon as a
hypothesis test says that its whole distance is beyond the bound. Under a random
rotation the part of a squared distance that falls into d of D dimensions is
distributed as Beta(d / 2, (D - d) / 2); a candidate goes when its partial
squared distance exceeds the bound times that distribution's 1 - ``ALPHA``
quantile, which a candidate within the bound does with probability ``ALPHA`` at
most. What is left is scored exactly, in double precision, on the original
vectors.

Fitted on a bounded sample, chosen by a hash: centroids from about ``MOST_SAMPLE``
vectors (``MOST_BYTES`` of them), and from ``TRIALS`` of them how many of the lists nearest to a query
hold its neighbours (``COVER`` of them). Every vector is indexed. There are about
sqrt(vectors) lists, and at most one for each ``PER_LIST`` sampled vectors.

Vectors that are equal are one class: it is scanned once and stands for its
k + 1 smallest ids (k and the query's own are all that can be asked for), which
are found by a limit before the shuffle, so a vector of a third of all rows is
one row of the index. Lists are dealt out in chunks of ``CHUNK`` classes by a
hash, and queries of a list in blocks of ``BLOCK``, so a hot list is many tasks'.

Defined cases: vectors null, empty, zero, or with a null or a component that
isn't finite take no part, nor do rows without an id; shorter vectors count as
ended by zeros; a repeated row, or one of the query's own id, is no candidate of
its query; an id with several vectors is one query, by its nearest; ties go to the smaller id; with fewer candidates than k all are
returned, since probing goes on until the lists hold k + 1 classes; an empty
table gives an empty result. Only the named columns are read, so extra columns
can't clash. No text is read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

K = 5
MOST_SAMPLE, MOST_BYTES, PER_LIST, TRIALS, COVER = 16_384, 64 << 20, 16, 256, 0.98
CHUNK, BLOCK, COLUMNS = 2048, 256, 16
ALPHA = 0.001
SEED = 11


def rotation(dims: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _padded(column: pa.Array, dims: int) -> np.ndarray:
    """(rows, dims) of a list column of finite numbers, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(n) and (n == dims).all():
        return flat.reshape(len(n), dims)
    out = np.zeros((len(n), dims))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _turned(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True) @ turn).astype(np.float32)


def fit_lists(x: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit length by spherical k-means."""
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(length > 0, total / np.maximum(length, 1e-30), c)
    return c


def probes_needed(x: np.ndarray, c: np.ndarray, k: int) -> int:
    """How many nearest lists hold ``COVER`` of the k nearest neighbours of sampled queries."""
    q = x[:TRIALS]
    if len(x) <= k + 1:
        return len(c)
    near = q @ x.T
    near[np.arange(len(q)), np.arange(len(q))] = -2
    best = np.argpartition(-near, k, axis=1)[:, :k]
    rank = np.argsort(np.argsort(-(q @ c.T), axis=1), axis=1)
    own = (x @ c.T).argmax(1)
    return int(np.quantile(rank[np.arange(len(q))[:, None], own[best]], COVER)) + 1


def usable(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part, with v in double precision."""
    v = F.col(vector).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~odd & F.exists("v", lambda x: x != 0))


def classes(points: DataFrame, k: int = K) -> DataFrame:
    """(a, b, v, ids): each different vector with its k + 1 smallest ids; a written table."""
    named = points.withColumn("a", F.xxhash64("v")).withColumn("b", F.xxhash64(F.lit("vector"), F.col("v"))).dropDuplicates(["a", "b", "id"])
    few = named.withColumn("_r", F.row_number().over(Window.partitionBy("a", "b").orderBy("id"))).where(F.col("_r") <= k + 1)
    return materialize(few.groupBy("a", "b").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids")), "classes")


class Index:
    """Centroids, the rotation, the number of probes, and lists of classes in chunks (a written table)."""

    def __init__(self, points: DataFrame, k: int = K):
        spark = points.sparkSession
        self.k, self.classes = k, classes(points, k)
        found = self.classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
        self.n, self.dims = found["n"], found["dims"] or 0
        if not self.n:
            return
        most = max(min(MOST_SAMPLE, MOST_BYTES // (8 * self.dims)), 1)
        place = F.pmod(F.xxhash64("a", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
        sample = self.classes.where(place < most / self.n).select("a", "v").toArrow()
        if not sample.num_rows:
            sample = self.classes.select("a", "v").limit(1).toArrow()
        turn, sample = rotation(self.dims), sample.sort_by("a")
        x = _turned(_padded(sample["v"], self.dims), turn)
        lists = max(1, min(round(self.n**0.5), len(x) // PER_LIST))
        self.centroids = fit_lists(x, lists)
        dims, centroids = self.dims, self.centroids

        def place_rows(batches):
            for b in batches:
                raw = _padded(b.column(2), dims)
                r = _turned(raw, turn)
                own = (r @ centroids.T).argmax(1).astype(np.int32) if len(r) else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(own), b.column(0), b.column(3), _rows(r), _rows(raw)], names=["list", "a", "ids", "turned", "raw"])

        placed = materialize(self.classes.select("a", "b", "v", "ids").mapInArrow(place_rows, "list int, a long, ids array<long>, turned binary, raw binary"), "placed")
        self.sizes = {r["list"]: r["n"] for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many as centroids
        parts = F.create_map(*[x for i, n in self.sizes.items() for x in (F.lit(i), F.lit(-(-n // CHUNK)))])
        chunk = F.pmod(F.xxhash64("a", F.lit("chunk")), parts[F.col("list")]).cast("int")
        self.chunks = {i: -(-n // CHUNK) for i, n in self.sizes.items()}
        packed = placed.withColumn("chunk", chunk).groupBy("list", "chunk").agg(F.collect_list(F.struct("ids", "turned", "raw")).alias("members"))
        self.lists = materialize(packed, "lists")
        self.probes = max(probes_needed(x, self.centroids, k), 1)
        self.turn, self.spark = turn, spark


def _rows(x: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _matrix(column: pa.Array, kind, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), dims)


def scan(q: np.ndarray, c: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that no test abandoned: ``q`` and ``c`` rotated unit vectors, ``bound`` squared distances."""
    dims = q.shape[1]
    first = slice(0, min(COLUMNS, dims))
    p = (q[:, first] ** 2).sum(1)[:, None] + (c[:, first] ** 2).sum(1)[None] - 2 * (q[:, first] @ c[:, first].T)
    i, j = np.nonzero(p <= _limit(bound, first.stop, dims)[:, None])
    p = p[i, j]
    for start in range(first.stop, dims, COLUMNS):
        block = slice(start, min(start + COLUMNS, dims))
        p = p + ((q[i, block] - c[j, block]) ** 2).sum(1)
        stay = p <= _limit(bound[i], block.stop, dims)
        i, j, p = i[stay], j[stay], p[stay]
    return i, j


@functools.cache
def share_quantile(d: int, dims: int) -> float:
    """The 1 - ``ALPHA`` quantile of Beta(d / 2, (dims - d) / 2), from its density on a fine grid."""
    x = (np.arange(200_000) + 0.5) / 200_000
    log = (d / 2 - 1) * np.log(x) + ((dims - d) / 2 - 1) * np.log1p(-x)
    upto = np.cumsum(np.exp(log - log.max()))
    return float(x[np.searchsorted(upto, (1 - ALPHA) * upto[-1])])


def _limit(bound: np.ndarray, d: int, dims: int) -> np.ndarray:
    """The largest partial squared distance over d dimensions that the test doesn't reject, with a margin for rounding."""
    return bound * (1.0 if d >= dims else share_quantile(d, dims)) * (1 + 1e-5) + 1e-6


def _best(query: np.ndarray, score: np.ndarray, lowest: np.ndarray, most: int) -> np.ndarray:
    """Places of each query's ``most`` first pairs by falling score, then by id."""
    order = np.lexsort((lowest, -score, query))
    new = np.ones(len(order), bool)
    new[1:] = query[order][1:] != query[order][:-1]
    nth = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[nth < most]


def _search(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, vec_id, score): the k first of each chunk, for ``queries(list, id, turned, raw, bound)``."""
    k, dims, parts = index.k, index.dims, index.chunks
    counts = {r["list"]: r["n"] for r in queries.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many as centroids
    if not counts:
        return index.spark.createDataFrame([], "query_id long, vec_id long, score double")
    blocks = F.create_map(*[x for i, n in counts.items() for x in (F.lit(i), F.lit(-(-n // BLOCK)))])
    block = F.pmod(F.xxhash64("id", F.lit("block")), blocks[F.col("list")])
    packed = queries.groupBy("list", block.alias("block")).agg(F.collect_list(F.struct("id", "turned", "raw", "bound")).alias("asked"))
    chunk_of = F.create_map(*[x for i, n in parts.items() for x in (F.lit(i), F.lit(n))])
    packed = packed.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunk_of[F.col("list")] - 1)))
    both = packed.join(index.lists, ["list", "chunk"]).select("asked", "members")

    def run(batches):
        for b in batches:
            for n in range(b.num_rows):
                asked, members = b.column(0)[n].values, b.column(1)[n].values
                q, qraw = _matrix(asked.field(1), np.float32, dims), _matrix(asked.field(2), np.float64, dims)
                c, craw = _matrix(members.field(1), np.float32, dims), _matrix(members.field(2), np.float64, dims)
                ids, off = members.field(0).flatten().to_numpy(), members.field(0).offsets.to_numpy()
                off = off - off[0]
                qid = asked.field(0).to_numpy()
                i, j = scan(q, c, asked.field(3).to_numpy())
                score = np.einsum("ij,ij->i", qraw[i], craw[j]) / (np.sqrt(np.einsum("ij,ij->i", qraw, qraw))[i] * np.sqrt(np.einsum("ij,ij->i", craw, craw))[j])
                keep = _best(i, score, ids[off[j]], k + 1)  # one may be the query's own class
                i, j, score = i[keep], j[keep], score[keep]
                size = (off[1:] - off[:-1])[j]
                row = np.repeat(np.arange(len(i)), size)
                vec = ids[off[j][row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)]
                other = vec != qid[i[row]]
                row, vec = row[other], vec[other]
                keep = _best(i[row], score[row], vec, k)
                yield pa.RecordBatch.from_arrays([pa.array(qid[i[row]][keep]), pa.array(vec[keep]), pa.array(score[row][keep])], names=["query_id", "vec_id", "score"])

    return both.mapInArrow(run, "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(rows: DataFrame, asked: Column, k: int = K, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of the rows for which ``asked`` (over the column ``id``) holds, among all rows."""
    spark = rows.sparkSession
    small_batches(spark)  # of whole chunks
    points = usable(rows, id_col, vector)
    index = Index(points, k)
    if not index.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, turn, centroids, sizes, probes = index.dims, index.turn, index.centroids, index.sizes, index.probes
    size = np.array([sizes.get(i, 0) for i in range(len(centroids))])

    def place(batches):
        for b in batches:
            raw = _padded(b.column(1), dims)
            r = _turned(raw, turn)
            order = np.argsort(-(r @ centroids.T), axis=1).astype(np.int32)
            order = [o[size[o] > 0] for o in order]  # empty lists hold nothing to scan
            need = [max(probes, int(np.searchsorted(np.cumsum(size[o]), k + 1)) + 1) for o in order]
            probed = [o[:n] for o, n in zip(order, need)]
            off = np.concatenate([[0], np.cumsum([len(p) for p in probed])]).astype(np.int32)
            flat = np.concatenate(probed) if probed else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(flat)), _rows(r), _rows(raw)], names=["id", "probed", "turned", "raw"])

    asking = points.where(asked).dropDuplicates(["id", "v"])
    queries = materialize(asking.select("id", "v").mapInArrow(place, "id long, probed array<int>, turned binary, raw binary"), "queries")
    beyond = F.lit(4.0)  # no two unit vectors are further apart
    first = queries.select(F.get("probed", F.lit(0)).alias("list"), "id", "turned", "raw", beyond.alias("bound"))
    near = materialize(_search(index, first), "near")
    least = _ranked(near, k).groupBy("query_id").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    bound = F.coalesce(F.greatest(2 - 2 * F.col("s"), F.lit(0.0)), beyond)
    more = queries.join(least, F.col("id") == F.col("query_id"), "left").select(F.explode(F.slice("probed", 2, len(centroids))).alias("list"), "id", "turned", "raw", bound.alias("bound"))
    found = near.unionByName(_search(index, materialize(more, "probes")))
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")
