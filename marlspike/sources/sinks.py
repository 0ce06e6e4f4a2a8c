"""Writers and rewrites: partitioned artifacts, manifests, upserts, trims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspike.functions.exprs import RESERVED, artifact_stem

from .scratch import file_system


def write_table(df: DataFrame, path: str) -> None:
    """Replace a table; the commit protocol publishes it as a whole."""
    df.write.mode("overwrite").parquet(path)


def write_by_key(df: DataFrame, path: str, key: str = "ticker") -> None:
    """One folder per key (its file-safe stem); only the keys at hand are replaced."""
    df.withColumn("stem", artifact_stem(key)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stem").parquet(path)


def stale_keys(existing: DataFrame, active: DataFrame, key: str = "ticker") -> DataFrame:
    """Keys that have artifacts but are no longer active."""
    return existing.select(key).distinct().join(active.select(key).distinct(), key, "left_anti")


def manifest(chunks: DataFrame, key: str = "ticker") -> DataFrame:
    """Per key: chunks once each by id, and a hash of the ids that no row has to hold: of the hashes of their ranges, by four characters and by two."""
    parts = chunks.select(key, "chunk_id").distinct().select(key, F.substring("chunk_id", 1, 4).alias("at"), F.col("chunk_id").alias("part"), F.lit(1).alias("n"))
    for width in (4, 2, 0):
        hashed = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "\n"), 256)
        parts = parts.groupBy(key, F.substring("at", 1, width).alias("to")).agg(F.sum("n").alias("n"), hashed.alias("part")).withColumnRenamed("to", "at")
    return parts.select(key, F.col("n").alias("chunks"), F.col("part").alias("ids_sha"))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], keep_if_null: list[str] = ()) -> DataFrame:
    """Incoming rows replace existing ones of the same key; columns of ``keep_if_null`` keep the old value where the new is null."""
    e, i = existing.alias("e"), incoming.withColumn("_new", F.lit(True)).alias("i")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"e.{k}").eqNullSafe(F.col(f"i.{k}"))
    cols = []
    for c in existing.columns:
        new, old = F.col(f"i.{c}"), F.col(f"e.{c}")
        cols.append((F.coalesce(new, old) if c in keep_if_null else F.when(F.col("i._new"), new).otherwise(old)).alias(c))
    return e.join(i, on, "full_outer").select(*cols)


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is not there yet, the first of each."""
    first = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*incoming.columns))).where("_n = 1").drop("_n")
    return first.join(existing.select(*keys), keys, "left_anti")


def trim(df: DataFrame, heavy: list[str]) -> tuple[DataFrame, list[str]]:
    """The table without its heavy columns, and which of them it had."""
    return df.drop(*heavy), [c for c in heavy if c in df.columns]


def update_rows(existing: DataFrame, patch: DataFrame, keys: list[str], columns: list[str], set_null: list[str] = ()) -> DataFrame:
    """``columns`` of existing rows set from ``patch``, which has a row for each key at most; null in a patch leaves a value, but for those of ``set_null``."""
    p = patch.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in columns], F.lit(True).alias("_patched"))
    put = lambda c: F.when(F.col("_patched"), F.col(f"_p_{c}")).otherwise(F.col(c)) if c in set_null else F.coalesce(F.col(f"_p_{c}"), F.col(c))
    return existing.join(p, keys, "left").select(*[put(c).alias(c) if c in columns else F.col(c) for c in existing.columns])


def delete_rows(existing: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(gone.select(*keys).distinct(), keys, "left_anti").select(*existing.columns)


def stems(spark: SparkSession, path: str) -> list[str]:
    """Stems of the keys that have a folder under ``path``."""
    fs, place = file_system(spark, path)
    return sorted(x.getPath().getName().split("=", 1)[1] for x in fs.listStatus(place) if x.getPath().getName().startswith("stem=")) if fs.exists(place) else []


def remove_stale(spark: SparkSession, path: str, active: DataFrame, key: str = "ticker") -> list[str]:
    """Delete the folders of keys that are not active; their stems in order."""
    listed = stems(spark, path)
    there = spark.createDataFrame([(x,) for x in listed], "stem string")
    gone = [r["stem"] for r in there.join(active.select(artifact_stem(key).alias("stem")).distinct(), "stem", "left_anti").orderBy("stem").collect()]
    for stem in gone:
        fs, place = file_system(spark, f"{path}/stem={stem}")
        fs.delete(place, True)
    return gone


def repair_names(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Rename key folders whose stem is a device name to the escaped stem; (from, to) of each."""
    done = []
    for stem in stems(spark, path):
        if stem.upper().split(".")[0] in RESERVED:
            fs, place = file_system(spark, f"{path}/stem={stem}")
            fs.rename(place, file_system(spark, f"{path}/stem=_{stem.upper()}")[1])
            done.append((stem, f"_{stem.upper()}"))
    return done
