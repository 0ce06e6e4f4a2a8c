"""Stream queries, run over all that the events table holds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlspike.streaming import streams as S

from .registry import query


def _final(rows, keys):
    """The last state of each key of an updating stream."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_batch")))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n", "_batch")


def _ntz(c):
    return F.to_timestamp_ntz(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf):
    rows = S.run_available(S.tumbling(S.events(spark, f"{sf}/events.parquet")), "update", spark)
    out = _final(rows, ["window", "event_type"])
    return out.select(_ntz("window.start").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query("WITH s AS (SELECT unnest([date_trunc('day', ts)::TIMESTAMP, date_trunc('day', ts)::TIMESTAMP - INTERVAL 1 DAY]) AS day FROM events) SELECT day, count(*) AS n FROM s GROUP BY 1")
def stream_sliding(spark, sf):
    rows = S.run_available(S.sliding(S.events(spark, f"{sf}/events.parquet")), "update", spark)
    return _final(rows, ["window"]).select(_ntz("window.start").alias("day"), "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), k AS (SELECT user_id, sum(new) AS sessions, count(*) AS events FROM g GROUP BY user_id) SELECT user_id, CAST(sessions AS BIGINT) AS sessions, events FROM k")
def stream_session(spark, sf):
    # complete mode: each batch gives all sessions so far, the last one the result
    rows = S.run_available(S.sessions(S.events(spark, f"{sf}/events.parquet")), "complete", spark)
    last = rows.agg(F.max("_batch")).first()[0]
    return rows.where(F.col("_batch") == F.lit(last)).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"))


@query("SELECT count(DISTINCT user_id) AS users FROM events")
def stream_dedupe(spark, sf):
    rows = S.run_available(S.first_of_key(S.events(spark, f"{sf}/events.parquet"), ["user_id"], "60 days"), "append", spark)
    return rows.agg(F.count("user_id").alias("users"))


@query("SELECT user_id, count(*) AS events, epoch_us(max(ts)) AS last_us FROM events GROUP BY user_id")
def stream_progress_state(spark, sf):
    rows = S.run_available(S.progress(S.events(spark, f"{sf}/events.parquet")), "update", spark)
    return _final(rows, ["user_id"]).select("user_id", "events", "last_us")
