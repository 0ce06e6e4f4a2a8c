"""Percentile ranks that are kept while batches of rows are merged.

Values stand in splits at cuts that were taken when the store was built; a split
keeps, for each of its rows, how many of its own values are smaller and how many
are equal. A row's rank adds the counts of the lower splits, one number for each
split. So a merged batch ranks again only the splits that lose or get a value;
all others stay as they were written, and only their offsets differ. Values of a
split are counted before they are ranked, so a value that most rows share is one
row of the ranking, and its rank reaches its rows without one task for them.

Under the store's folder: ``cuts``; ``rows`` by version, feature and split; and
``splits``, a version's list of the live version of each split, written last: a
merge that dies before it leaves the store as it was. Splits only grow uneven,
never wrong; a store is built anew when they have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspike.sources.scratch import file_system, written

#: Splits of a feature; ``CUTS - 1`` numbers of each feature are kept, and a row of each split.
CUTS = 64
#: Rows for each file of a split.
FILE_ROWS = 4_000_000
_KEYS = ["feature", "split"]


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, place = file_system(spark, f"{path}/splits")
    return sorted(int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(place) if fs.exists(file_system(spark, f"{x.getPath()}/_SUCCESS")[1])) if fs.exists(place) else []


def _placed(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows(ticker, feature, value)`` with their split; values that aren't numbers count as null and stand in split -1."""
    value = F.when(~F.isnan("value"), F.col("value"))
    split = F.when(value.isNull(), F.lit(-1)).otherwise(F.size(F.filter(F.coalesce("cuts", F.array().cast("array<double>")), lambda c: c < F.col("value"))))
    return rows.withColumn("value", value).join(F.broadcast(cuts), "feature", "left").select("ticker", "feature", "value", split.cast("int").alias("split"))  # a row for each feature


def _ranked(placed: DataFrame) -> tuple[DataFrame, int]:
    """``placed`` with ``below`` and ``equal`` within the split, and in how many files a split goes."""
    counts = placed.where("split >= 0").groupBy(*_KEYS, "value").agg(F.count(F.lit(1)).alias("equal"))
    counts = written(counts.withColumn("below", F.sum("equal").over(Window.partitionBy(*_KEYS).orderBy("value")) - F.col("equal")), "counts")
    total = counts.agg(F.sum("equal")).first()[0] or 0
    most = total // 1000  # fewer than 1,000 values have more rows than that
    hot, on = F.broadcast(counts.where(F.col("equal") > most)), [*_KEYS, "value"]
    first = placed.join(hot, on)
    rest = placed.join(hot, on, "left_anti").join(counts.where(F.col("equal") <= most), on, "left")
    return first.unionByName(rest), 1 + total // (CUTS * FILE_ROWS)


def _write(spark: SparkSession, path: str, version: int, placed: DataFrame, held: DataFrame | None) -> None:
    ranked, files = _ranked(placed)
    ranked.withColumn("version", F.lit(version)).repartition("version", *_KEYS, F.pmod(F.xxhash64("ticker"), F.lit(files))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", *_KEYS).parquet(f"{path}/rows")
    new = spark.read.parquet(f"{path}/rows").where(F.col("version") == version).groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n")).withColumn("live", F.lit(version))
    if held is not None:
        new = held.select(*_KEYS, "n", "live").unionByName(new)
    new.coalesce(1).write.mode("overwrite").parquet(f"{path}/splits/version={version}")


def build(rows: DataFrame, path: str, cuts: int | None = None) -> None:
    """A store of ``rows(ticker, feature, value)``, one row for each ticker and feature, in so many splits a feature."""
    cuts = cuts or CUTS
    spark = rows.sparkSession
    shares = F.array(*[F.lit(k / cuts) for k in range(1, cuts)])
    rows.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("feature").agg(F.array_distinct(F.percentile_approx(F.col("value").cast("double"), shares, 1000)).alias("cuts")).coalesce(1).write.parquet(f"{path}/cuts")
    _write(spark, path, 0, _placed(rows, spark.read.parquet(f"{path}/cuts")), None)


def _live(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/splits/version={_versions(spark, path)[-1]}")


def merge(spark: SparkSession, path: str, before: DataFrame, after: DataFrame) -> DataFrame:
    """Put ``after(ticker, feature, value)`` in the place of ``before``, the rows that the store has of the batch; the splits ranked again.

    A ticker may be in one of the two alone: it goes, or is new."""
    cuts, live = spark.read.parquet(f"{path}/cuts"), _live(spark, path)
    gone, come = _placed(before, cuts), written(_placed(after, cuts), "after")
    touched = written(gone.select(*_KEYS).union(come.select(*_KEYS)).distinct(), "touched")
    changed = [tuple(r) for r in touched.collect()]  # CUTS + 1 a feature at most
    if not changed:
        return touched
    rows = spark.read.parquet(f"{path}/rows")
    # equal pairs of partition values, so that only their folders are opened
    version = {(r["feature"], r["split"]): r["live"] for r in live.collect()}
    wanted = [p for p in changed if p in version]
    kept = rows.where(F.concat_ws("|", "version", "split", "feature").isin([f"{version[p]}|{p[1]}|{p[0]}" for p in wanted])).select("ticker", "feature", "value", "split").join(gone.select("ticker", "feature"), ["ticker", "feature"], "left_anti")
    held = live.join(touched, _KEYS, "left_anti")
    _write(spark, path, _versions(spark, path)[-1] + 1, kept.unionByName(come.select("ticker", "feature", "value", "split")), held)
    return touched


def percentiles(spark: SparkSession, path: str, digits: int = 6) -> DataFrame:
    """(ticker, feature, value, pct) of all rows: (smaller + (equal - 1) / 2) / (n - 1); one value alone is 0.5, null stays null."""
    live = _live(spark, path)
    whole = Window.partitionBy("feature")
    counted = F.when(F.col("split") >= 0, F.col("n")).otherwise(0)
    live = live.withColumn("before", F.coalesce(F.sum(counted).over(whole.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum(counted).over(whole))
    rows = spark.read.parquet(f"{path}/rows").join(F.broadcast(live.select(*_KEYS, F.col("live").alias("version"), "before", "all")), [*_KEYS, "version"])  # a row for each split
    pct = F.when(F.col("split") >= 0, F.when(F.col("all") == 1, F.lit(0.5)).otherwise((F.col("before") + F.col("below") + (F.col("equal") - 1) / 2) / (F.col("all") - 1)))
    return rows.select("ticker", "feature", "value", F.round(pct, digits).alias("pct"))
