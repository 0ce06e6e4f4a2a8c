"""Executed bin-packed compaction of a table's files (operator 13).

Rows are written as one file for each (day, lot, piece), small files of a day
are packed into groups, and each group of several is rewritten as one file.
The packing runs in lockstep over blocks of ``DAYS`` successive days: the block
holds a matrix of what is left in each group of each day, and at each size rank
one boolean argmax finds, for every day at once, the first group that the day's
file of that rank fits into. Groups that weren't opened yet are wholly free, so
the first that fits is the earliest opened one or else the next new one.

With S(x) = 1 + floor(R / x) of R rows, a day of r rows has at most
1 + floor(r / S(200)) lots of four pieces, so there are at most four files for
each of (days + 200), whatever R: lists of files (not of rows) are as short as
that. A day's block has at most 4 * (DAYS + 200) files.

Rows go to tasks by file, and a file is sorted (spilling) and written by one
task as a stream; so are the digests, read back in file order. Row counts of a
day reach its rows by ``many_to_one``, so a day with most rows is no task's
alone. Only the number of rows, and the names of replaced files, one at a time,
reach the driver, which deletes these files.

A lost executor's tasks run again, and Spark's committer shows only whole files.
Replaced files are deleted after the new ones are committed; a run that dies
between leaves a folder that nothing names, since every call takes a new one.

Defined cases: a null time is a day of its own (null, listed first) and sorts first; a
null id counts as an empty text in the hash, and is left out of the smallest,
largest and ids_sha256; a null value, or one that isn't a number, adds 0 cents;
repeated rows stay, next to each other; texts of any length are carried as they
are; an empty table writes no file and gives an empty result; columns with any
names are kept, since names used here are lengthened until they are free.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import many_to_one, materialize, scratch_dir

#: Successive days whose files are packed together.
DAYS = 16
LOT, SMALL, FULL = 200, 750, 400


def share(rows: int, x: int) -> int:
    """S(x) of a table of so many rows."""
    return 1 + rows // x


def lockstep(sizes: np.ndarray, most: int) -> np.ndarray:
    """The group of each file: ``sizes`` (days, ranks) holds each day's file sizes in falling order, then zeros.

    First fit: a file joins the first group of its day that holds at most ``most`` with it. Returns -1 where there is no file."""
    days, ranks = sizes.shape
    left = np.full((days, max(ranks, 1)), most, np.int64)
    group, day = np.full((days, ranks), -1, np.int64), np.arange(days)
    for rank in range(ranks):
        now = sizes[:, rank]
        first = (left >= now[:, None]).argmax(1)
        there = now > 0
        left[day[there], first[there]] -= now[there]
        group[there, rank] = first[there]
    return group


def pack_block(files: pd.DataFrame, most: int) -> pd.DataFrame:
    """``files(_day, _lot, _piece, _rows)`` of some days with the group and the place in it, by :func:`lockstep`."""
    files = files.sort_values(["_day", "_rows", "_lot", "_piece"], ascending=[True, False, True, True], na_position="first").reset_index(drop=True)
    day = files["_day"].fillna(np.iinfo(np.int64).min).to_numpy(np.int64)
    first = np.ones(len(files), bool)
    first[1:] = day[1:] != day[:-1]
    row = np.cumsum(first) - 1
    rank = np.arange(len(files)) - np.flatnonzero(first)[row]
    sizes = np.zeros((row[-1] + 1, rank.max() + 1), np.int64)
    sizes[row, rank] = files["_rows"].to_numpy()
    return files.assign(_group=lockstep(sizes, most)[row, rank], _nth=rank)


def _fresh(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Names:
    """Names of the partition columns, free in the table."""

    def __init__(self, df: DataFrame):
        self.day, self.lot, self.piece = (_fresh(df, x) for x in ("day", "lot", "piece"))
        self.all = [self.day, self.lot, self.piece]


def write_pieces(rows: DataFrame, folder: str, names: Names, key: str, time: str) -> int:
    """Write one sorted file for each (day, lot, piece) under ``folder``; the number of rows."""
    total = rows.count()
    d, h = _fresh(rows, "_d"), F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    lots, n = _fresh(rows, "_lots"), _fresh(rows, "_n")
    day = F.unix_date(F.col(time).cast("date")).cast("long")
    dated = rows.withColumn(d, F.coalesce(day, F.lit(-(2**62))))  # one key for rows without a time
    days = dated.groupBy(d).agg(F.count(F.lit(1)).alias(n))
    days = materialize(days.withColumn(lots, 1 + F.floor(F.col(n) / F.lit(share(total, LOT)))), "days")
    placed = many_to_one(dated, days, d, n)
    placed = placed.withColumn(names.day, day).withColumn(names.lot, F.pmod(F.floor(h / 16), F.col(lots)).cast("long")).withColumn(names.piece, F.least(h % 4, F.floor(h / 4) % 4).cast("long"))
    placed = placed.select(*names.all, *rows.columns).repartition(*names.all)
    placed.sortWithinPartitions(*names.all, F.col(time).asc_nulls_first(), F.col(key).asc_nulls_first(), *_rest(rows, key, time)).write.partitionBy(*names.all).parquet(folder)
    return total


def _rest(rows: DataFrame, key: str, time: str) -> list[Column]:
    """An order of rows alike in time and id, so that a task that runs again writes the same file."""
    return [F.xxhash64(*[F.col(c) for c in rows.columns if c not in (key, time)])] if len(rows.columns) > 2 else []


def read_folder(spark, folder: str, names: Names, schema) -> DataFrame:
    """The folder's rows, in table order, with _day, _lot, _piece, _path and _at (the place in the file)."""
    kinds = StructType([*schema.fields, *[StructField(c, LongType()) for c in names.all]])
    rows = spark.read.schema(kinds).parquet(folder)
    return rows.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(schema.names)], *[F.col(c).alias(a) for c, a in zip(names.all, ("_day", "_lot", "_piece"))], F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_at"))


def plan(files: DataFrame, total: int) -> DataFrame:
    """``files(_day, _lot, _piece, _path, _rows)`` with _group and _nth, null where a file is no small one; a written table."""
    schema = StructType([*files.schema.fields, StructField("_group", LongType()), StructField("_nth", LongType())])
    most = share(total, FULL)
    small = files.where(F.col("_rows") < share(total, SMALL))
    block = F.coalesce(F.floor(F.col("_day") / DAYS), F.lit(-(2**62))).alias("_block")

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        return pack_block(block, most)

    packed = small.groupBy(block).applyInPandas(pack, schema)
    large = files.where(F.col("_rows") >= share(total, SMALL))
    return materialize(packed.unionByName(large, allowMissingColumns=True), "packed")


def _name(lot: str = "_lot", piece: str = "_piece") -> Column:
    return F.concat_ws("-", F.col(lot).cast("string"), F.col(piece).cast("string"))


def compact(rows: DataFrame, key: str = "click_id", time: str = "arrived_at", value: str = "value", folder: str | None = None) -> tuple[str, DataFrame]:
    """Write and compact ``rows``; the folder, and a row for each final file with its first source, sources, digests and path."""
    spark = rows.sparkSession
    folder = folder or f"{scratch_dir(spark)}/marlspike/compacted-{uuid.uuid4().hex}"
    names, schema = Names(rows), rows.schema
    total = write_pieces(rows, folder, names, key, time)
    if not total:
        return folder, spark.createDataFrame([], _RESULT)
    written = read_folder(spark, folder, names, schema)
    files = materialize(written.groupBy("_day", "_lot", "_piece", "_path").agg(F.count(F.lit(1)).alias("_rows")), "files")
    packed = plan(files, total)
    groups = packed.where("_group is not null").groupBy("_day", "_group").agg(F.array_sort(F.collect_list(F.struct("_nth", "_lot", "_piece", "_path"))).alias("_members"))
    groups = materialize(groups.where(F.size("_members") > 1), "groups")
    moved = groups.select(F.col("_members")[0]["_lot"].alias("_to_lot"), F.col("_members")[0]["_piece"].alias("_to_piece"), F.explode("_members").alias("m")).select("_to_lot", "_to_piece", F.col("m._nth").alias("_nth"), F.col("m._path").alias("_path"))
    source = written.join(moved, "_path")
    target = [F.col("_day").alias(names.day), F.col("_to_lot").alias(names.lot), F.col("_to_piece").alias(names.piece)]
    nth, at = _fresh(rows, "_nth"), _fresh(rows, "_at")
    joined = source.select(*target, F.col("_nth").alias(nth), F.col("_at").alias(at), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(schema.names)])
    joined = joined.repartition(*names.all).sortWithinPartitions(*names.all, nth, at).drop(nth, at)
    joined.write.mode("append").partitionBy(*names.all).parquet(folder)
    for r in groups.select(F.explode("_members._path").alias("path")).toLocalIterator():  # names only, see above
        place = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(r["path"]))
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, False)
    final = read_folder(spark, folder, names, schema)
    cols = {c: f"_c{i}" for i, c in enumerate(schema.names)}
    digests = _digests(final.select("_day", "_lot", "_piece", "_path", "_at", F.col(cols[key]).cast("long").alias("_id"), _cents(F.col(cols[value])).alias("_cents")))
    several = groups.select("_day", F.col("_members")[0]["_lot"].alias("_lot"), F.col("_members")[0]["_piece"].alias("_piece"), F.concat_ws(",", F.transform("_members", lambda m: F.concat_ws("-", m["_lot"].cast("string"), m["_piece"].cast("string")))).alias("_several"))
    on = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("_day", "_lot", "_piece")]
    out = digests.alias("x").join(several.alias("y"), on[0] & on[1] & on[2], "left")
    listed = F.lit(",".join(schema.names))
    return folder, out.select(F.col("x._day").alias("day"), F.col("x._lot").alias("lot"), F.col("x._piece").alias("piece"), "n_rows", "min_id", "max_id", "cents", F.coalesce("_several", _name("x._lot", "x._piece")).alias("sources"), "ids_sha256", listed.alias("columns"), F.col("_path").alias("path"), F.col("_several").isNotNull().alias("rewritten"))


def _cents(value: Column) -> Column:
    value = value.cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit(0)).otherwise(F.floor(100 * value + 0.5)).cast("long")


_RESULT = "day long, lot long, piece long, n_rows long, min_id long, max_id long, cents long, sources string, ids_sha256 string, columns string, path string, rewritten boolean"
_DIGESTS = "_day long, _lot long, _piece long, _path string, n_rows long, min_id long, max_id long, cents long, ids_sha256 string"


def _digests(rows: DataFrame) -> DataFrame:
    """One row for each file, from ``rows(_day, _lot, _piece, _path, _at, _id, _cents)``; a file is read in order as a stream."""
    ordered = rows.repartition("_path").sortWithinPartitions("_path", "_at")

    def run(batches):
        now, sha, n, low, high, cents, began = None, None, 0, None, None, 0, False

        def done():
            return pa.RecordBatch.from_pylist([dict(zip(("_day", "_lot", "_piece", "_path"), now)) | {"n_rows": n, "min_id": low, "max_id": high, "cents": cents, "ids_sha256": sha.hexdigest()}], schema=kind)

        kind = pa.schema([("_day", pa.int64()), ("_lot", pa.int64()), ("_piece", pa.int64()), ("_path", pa.string()), ("n_rows", pa.int64()), ("min_id", pa.int64()), ("max_id", pa.int64()), ("cents", pa.int64()), ("ids_sha256", pa.string())])
        for b in batches:
            codes = b.column(3).dictionary_encode()
            code = codes.indices.to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1, [len(code)]]) if len(code) else np.zeros(0, np.int64)
            for s, e in zip(cuts[:-1], cuts[1:]):
                key = tuple(b.column(i)[int(s)].as_py() for i in range(4))
                if key != now:
                    if now is not None:
                        yield done()
                    now, sha, n, low, high, cents, began = key, hashlib.sha256(), 0, None, None, 0, False
                ids = b.column(5).slice(s, e - s).drop_null().to_numpy()
                n += int(e - s)
                cents += int(b.column(6).slice(s, e - s).to_numpy().sum())
                if len(ids):
                    low, high = min(int(ids.min()), low if low is not None else int(ids[0])), max(int(ids.max()), high if high is not None else int(ids[0]))
                    sha.update((("," if began else "") + ",".join(map(str, ids.tolist()))).encode())
                    began = True
        if now is not None:
            yield done()

    return ordered.mapInArrow(run, _DIGESTS)
