"""Vectors of chunks that are made once: a store addressed by content, filled batch by batch, resumable at any batch.

A chunk's vector depends on its text and on the model and its configuration, so
a store is one folder for each fingerprint of these, and a chunk is known by its
id and the hash of its text. A batch is a folder of its own, committed by
Spark's writer as a whole; a run takes up the chunks that no committed batch
has, so one that stopped midway writes each vector once when it is started
again. Batches hold ``BATCH`` chunks of a stable order (by hash), of any number.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.sources.scratch import file_system, written

BATCH = 1_000_000


def fingerprint(model: str, config: dict) -> str:
    """A name for the model with its configuration, whatever the order of its keys."""
    import hashlib

    return hashlib.sha256(json.dumps([model, config], sort_keys=True).encode()).hexdigest()[:16]


class Store:
    """Vectors under ``path`` for one model and configuration."""

    def __init__(self, spark: SparkSession, path: str, model: str, config: dict, dims: int):
        self.spark, self.dims, self.print = spark, dims, fingerprint(model, {**config, "dims": dims})
        self.path = f"{path}/{self.print}"

    def batches(self) -> list[int]:
        """Numbers of the batches that were written whole."""
        fs, place = file_system(self.spark, self.path)
        if not fs.exists(place):
            return []
        return sorted(int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(place) if fs.exists(file_system(self.spark, f"{x.getPath()}/_SUCCESS")[1]))

    def read(self) -> DataFrame:
        """(chunk_id, text_hash, vector) of all committed batches."""
        done = self.batches()
        kinds = "chunk_id string, text_hash string, vector array<float>"
        return self.spark.read.schema(kinds).parquet(*[f"{self.path}/batch={n}" for n in done]) if done else self.spark.createDataFrame([], kinds)

    def missing(self, chunks: DataFrame) -> DataFrame:
        """(chunk_id, text_hash, text) of ``chunks(chunk_id, text)`` without a vector of their present text, each once."""
        named = chunks.select("chunk_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["chunk_id", "text_hash"])
        return named.join(self.read().select("chunk_id", "text_hash"), ["chunk_id", "text_hash"], "left_anti")

    def build(self, chunks: DataFrame, embed: Callable[[Column], Column], batch: int = BATCH) -> int:
        """Make what is missing, a batch at a time; how many batches were written. ``embed`` is a column function of the caller's.

        A vector of another length than the store's ends the run; batches before it stay."""
        todo = written(self.missing(chunks), "missing")
        n = todo.count()
        parts, first = -(-n // batch), 1 + max(self.batches(), default=-1)
        for k in range(parts):
            own = todo.where(F.pmod(F.xxhash64("chunk_id", "text_hash"), F.lit(parts)) == k)
            made = own.select("chunk_id", "text_hash", embed(F.col("text")).cast("array<float>").alias("vector"))
            wrong = F.concat(F.lit("a vector without "), F.lit(self.dims), F.lit(" numbers: "), "chunk_id")
            made.withColumn("vector", F.when(F.size("vector") == self.dims, F.col("vector")).otherwise(F.raise_error(wrong))).write.mode("overwrite").parquet(f"{self.path}/batch={first + k}")
        return parts

    def of(self, chunks: DataFrame) -> DataFrame:
        """``chunks(chunk_id, text)`` with ``vector``, null where the store has none of the present text."""
        named = chunks.withColumn("text_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
        return named.join(self.read().dropDuplicates(["chunk_id", "text_hash"]), ["chunk_id", "text_hash"], "left").drop("text_hash")

    def prune(self, chunks: DataFrame) -> DataFrame:
        """What the store has of chunks or texts that are no more."""
        live = chunks.select("chunk_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))
        return self.read().join(live, ["chunk_id", "text_hash"], "left_anti")


def hashed_counts(dims: int, tokens: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A column function: counts of hashed terms, for a store without a model's service."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dims)

    def embed(text: Column) -> Column:
        slots = F.transform(tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dims)).cast("int"))
        return F.transform(zero, lambda z, i: F.size(F.filter(slots, lambda s: s == i)).cast("float"))

    return embed
