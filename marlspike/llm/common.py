"""Shared building blocks: scratch tables, row handles, ordered prefix sums, joins of hot keys, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """Folder shared by driver and executors: what ``spark.checkpoint.dir`` names.

    Only a session on one machine may leave it unset and gets a temporary folder; elsewhere that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="marlspike-"))
    return f"file://{_own_dir[0]}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Cuts the lineage and lets several later jobs reuse the rows; unlike a
    local checkpoint the files outlive any executor.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/marlspike/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table from :func:`materialize` that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "_scratch", None)
    if path:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Bound the bytes that one Arrow batch of whole texts holds, whatever the texts' lengths.

    The bound is read when a query runs, so it is set for the session and stays; a lower one is left as it is."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(key, str(most))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fold that no model may learn from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def handle(doc_id: str, text: str) -> Column:
    """128 bits by which a document is found again: two unlike hashes of id and text. Rows alike in both share it."""
    return F.struct(F.xxhash64(F.col(doc_id), F.col(text)).alias("a"), F.xxhash64(F.lit("handle"), F.col(text), F.col(doc_id)).alias("b"))


def range_sorted(df: DataFrame, order: list, name: str) -> DataFrame:
    """Range-partition by ``order`` and keep the partition's number as ``_pid`` (a written table)."""
    n = partitions(df.sparkSession)
    return materialize(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()), name)


def prefix_sum(ranged: DataFrame, groups: list[str], order: list, weight: Column, out: str) -> DataFrame:
    """Exact running sum of ``weight`` (a long) up to and with each row, within ``groups``.

    ``ranged`` comes from :func:`range_sorted` with ``groups + order``: a group
    of any size is spread over ranges, so each window sees one range only; the
    ranges' totals (one row for each range and group in it) are summed apart.
    """
    local = Window.partitionBy("_pid", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumn("_w", weight).withColumn("_run", F.sum("_w").over(local))
    totals = rows.groupBy("_pid", *groups).agg(F.sum("_w").alias("_t"))
    totals = totals.select(F.col("_pid").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
                           F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    on = F.col("_pid") == F.col("_p")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = rows.join(totals, on, "left")
    return joined.withColumn(out, F.col("_run") + F.col("_before")).drop("_p", "_w", "_run", "_before", *[f"_g{i}" for i in range(len(groups))])


def many_to_one(rows: DataFrame, ones: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of ``rows`` with ``ones``, a written table with one row for each ``key``; ``count`` there says how many of ``rows`` have it.

    A key with more than a thousandth of all rows goes by a broadcast (there are fewer than 1,000 of
    these, whatever the input), the others by a shuffle, in which no task then gets one key's bulk."""
    most = (ones.agg(F.sum(count)).first()[0] or 0) // 1000
    hot = F.broadcast(ones.where(F.col(count) > most).drop(count))
    cold = ones.where(F.col(count) <= most).drop(count)
    spread = rows.join(hot, key)
    return spread.unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


#: Edge lists up to this length (16 bytes each) fit one task; their steps are joined in one plan.
FEW_EDGES = 1_000_000


def _with_lowest(edges: DataFrame, lowest: Column, few: bool) -> tuple[DataFrame, list[DataFrame]]:
    """``edges(u, v)`` with ``m``, the ``lowest`` of each u, and the tables written on the way."""
    m = edges.groupBy("u").agg(lowest.alias("m"), F.count(F.lit(1)).alias("c"))
    if few:
        return edges.join(m.drop("c"), "u"), []
    m = materialize(m, "cc-lowest")
    return many_to_one(edges, m, "u", "c"), [m]


def connected_components(edges: DataFrame) -> DataFrame:
    """Label each vertex of ``edges(a long, b long)`` with the smallest vertex it reaches.

    Alternates large-star and small-star steps until nothing changes; the edge
    list never grows beyond twice its first size and stays distributed, and a
    vertex with very many edges is no task's alone. Vertices without an edge
    don't appear. Returns (v, component).
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    last = None
    while True:
        few = last is not None and last[0] <= FEW_EDGES  # then a hot vertex is no burden, and tables between the steps are
        both = e.union(e.select(F.col("v"), F.col("u")))
        large, held = _with_lowest(both, F.least("u", F.min("v")), few)
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        if not few:
            large = materialize(large, "cc-edges")
            held.append(large)
        moved, more = _with_lowest(large, F.min("v"), few)
        small = (moved.select(F.explode(F.array(F.struct(F.col("v").alias("x"), F.col("m")), F.struct(F.col("u").alias("x"), F.col("m")))).alias("s"))
                 .select(F.col("s.x").alias("u"), F.col("s.m").alias("v")).where("u <> v").distinct())
        before, e = e, materialize(small, "cc")
        now = e.agg(F.count(F.lit(1)), *[F.sum(F.xxhash64(F.lit(s), "u", "v").cast("decimal(38,0)")) for s in (1, 2)]).first()
        for old in (before, *held, *more):
            discard(old)
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("v"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v").alias("component")).distinct())
