"""Structured Streaming: resumable ingestion, windows with watermarks, dedupe and per-key state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from marlspike.sources.scratch import file_system, fresh_path


def events(spark: SparkSession, path: str) -> DataFrame:
    """A folder of event files as a stream; event times get a zone so that watermarks accept them."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(e: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    return e.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sliding(e: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    return e.withWatermark("ts", late).groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n"))


def sessions(e: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    return e.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("window"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def first_of_key(e: DataFrame, keys: list[str], late: str = "2 days") -> DataFrame:
    return e.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def progress(e: DataFrame) -> DataFrame:
    """(user_id, events, last_ts): running totals by key in state."""

    def update(key, batches, state):
        n, last = state.get if state.exists else (0, 0)
        for pdf in batches:
            n += len(pdf)
            last = max(last, int(pdf["ts"].max().value // 1000))
        state.update((n, last))
        yield pd.DataFrame({"user_id": [key[0]], "events": [n], "last_us": [last]})

    return e.groupBy("user_id").applyInPandasWithState(update, "user_id long, events long, last_us long", "n long, last long", "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, mode: str, spark: SparkSession, checkpoint: str | None = None) -> DataFrame:
    """Process all that is there and return the rows of all runs, with ``_batch``.

    ``checkpoint`` names a shared folder; a later run with it goes on from here, and its result holds the earlier batches too.
    A batch is written to a folder of its own, so one that is run again replaces itself."""
    base = (checkpoint or fresh_path(spark, "stream")).rstrip("/")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/_batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    schema = stream.schema.add("_batch", "integer")
    fs, place = file_system(spark, f"{base}/rows")
    if not fs.exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{base}/rows").parquet(f"{base}/rows")
