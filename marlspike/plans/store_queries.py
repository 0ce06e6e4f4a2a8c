"""Queries of what is kept between runs: ranks under merges, vectors, checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlspike.functions.exprs import search_tokens
from marlspike.operators import rank_store as RS
from marlspike.operators import vector_store as VS
from marlspike.sources import checkpoints as CP
from marlspike.sources.scratch import fresh_path
from marlspike.sources.tables import table

from .registry import query
from .search_queries import TOK


@query("""WITH v AS (SELECT c_custkey AS ticker, unnest(['balance', 'debt']) AS feature, unnest([CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 7 < 3 THEN c_acctbal + 5000 ELSE c_acctbal END, CASE WHEN c_custkey % 7 < 2 THEN least(c_acctbal, 0) - 100 ELSE least(c_acctbal, 0) END]) AS value FROM customer WHERE c_custkey % 7 <> 3),
r AS (SELECT *, count(*) OVER (PARTITION BY feature, value) AS eq, rank() OVER (PARTITION BY feature ORDER BY value) - 1 AS below, count(*) OVER (PARTITION BY feature) AS n FROM v WHERE value IS NOT NULL)
SELECT ticker, feature, value, round((below + (eq - 1) / 2.0::DOUBLE) / (n - 1), 6) AS pct FROM r UNION ALL SELECT ticker, feature, value, NULL FROM v WHERE value IS NULL""")
def ranks_after_merges(spark, sf):
    """Ranks of two features of all customers after three merged batches: raised balances, larger debts, and customers that are gone; the same as a whole ranking."""
    c, path, k = table(spark, sf, "customer"), fresh_path(spark, "ranks"), F.col("c_custkey") % 7
    long = lambda df, raised, owing: df.select(F.col("c_custkey").alias("ticker"), F.explode(F.map_from_arrays(F.array(F.lit("balance"), F.lit("debt")), F.array(F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal") + raised), F.least("c_acctbal", F.lit(0.0)) - owing))).alias("feature", "value"))
    RS.build(long(c, 0, 0), path, cuts=12)
    RS.merge(spark, path, long(c.where(k < 3), 0, 0), long(c.where(k < 3), 5000, 0))
    RS.merge(spark, path, long(c.where(k < 2), 5000, 0), long(c.where(k < 2), 5000, 100))
    RS.merge(spark, path, long(c.where(k == 3), 0, 0), long(c.where(k == 3), 0, 0).limit(0))
    return RS.percentiles(spark, path)


_LENGTHS = [4, 8, 12]
_COUNTS = ", ".join(f"len(list_filter(t, lambda x: length(x) {'<= 4' if n == 4 else f'> {n - 4} AND length(x) <= {n}'}))" for n in _LENGTHS)


def _by_length(text):
    """Counts of short, middling and long terms: a vector that SQL can make too."""

    def within(n):
        return lambda x: (F.length(x) <= n) & (F.length(x) > (0 if n == 4 else n - 4))

    return F.array(*[F.size(F.filter(search_tokens(text), within(n))) for n in _LENGTHS])


@query(f"SELECT doc_id::VARCHAR AS chunk_id, [{_COUNTS}]::FLOAT[] AS v FROM (SELECT doc_id, {TOK.format('text')} AS t FROM documents)".replace("SELECT doc_id::VARCHAR AS chunk_id, [", "SELECT chunk_id, v[1] AS short, v[2] AS middling, v[3] AS long FROM (SELECT doc_id::VARCHAR AS chunk_id, [") + ")")
def resumed_vectors(spark, sf):
    """Vectors of all documents by a run that stops after two batches of stale texts and is started again, each once and of its present text."""
    chunks = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    store = VS.Store(spark, fresh_path(spark, "vectors"), "term lengths", {"bounds": _LENGTHS}, 3)
    part = F.pmod(F.xxhash64("chunk_id"), F.lit(3))
    store.build(chunks.where(part == 0), _by_length)
    store.build(chunks.where(part == 1).withColumn("text", F.lit("stale")), _by_length)
    store.build(chunks, _by_length)
    live = chunks.select("chunk_id", F.sha2("text", 256).alias("text_hash"))
    v = store.read().join(live, ["chunk_id", "text_hash"], "left_semi")
    return v.select("chunk_id", *[F.col("vector")[i].cast("double").alias(n) for i, n in enumerate(("short", "middling", "long"))])


def _batches(spark, sf):
    """Suppliers as a run's records, 25 a batch; every 13th failed, and the last batch still has one to do."""
    s, key = table(spark, sf, "supplier"), F.col("s_suppkey")
    last = s.agg(F.max("s_suppkey")).first()[0]
    status = F.when(key == last, "pending").when(key % 13 == 0, "failed").otherwise("ok")
    rows = s.select(((key - 1) / 25).cast("int").alias("batch"), key.cast("string").alias("ticker"), status.alias("status"), F.when(status == "failed", "NO_FACTS").alias("error"), F.to_json(F.struct(F.round("s_acctbal", 2).alias("balance"), "s_name")).alias("payload"))
    folder = fresh_path(spark, "checkpoints")
    CP.write(rows, folder)
    return folder


_STATE = "b AS (SELECT (s_suppkey - 1) // 25 AS batch, s_suppkey, s_name, s_acctbal, CASE WHEN s_suppkey = max(s_suppkey) OVER () THEN 'pending' WHEN s_suppkey % 13 = 0 THEN 'failed' ELSE 'ok' END AS status FROM supplier)"


@query(f"WITH {_STATE} SELECT batch::INT AS batch, s_suppkey::VARCHAR AS ticker, status, CASE WHEN status = 'failed' THEN 'NO_FACTS' END AS error, round(s_acctbal, 2) AS balance FROM b WHERE (s_suppkey - 1) // 25 NOT IN (SELECT batch FROM b WHERE status = 'pending')")
def checkpoint_scan(spark, sf):
    """Records of all complete batches, read lazily from their files."""
    return CP.scan(spark, _batches(spark, sf)).select("batch", "ticker", "status", "error", F.get_json_object("payload", "$.balance").cast("double").alias("balance"))


@query(f"WITH {_STATE} SELECT s_suppkey::VARCHAR AS ticker, status, s_name AS name FROM b WHERE s_suppkey IN (3, 26, 9999999) OR s_suppkey = (SELECT max(s_suppkey) FROM supplier)")
def checkpoint_lookup(spark, sf):
    """A few tickers by the provider, unfinished batches included: only the files that name them are opened."""
    last = str(table(spark, sf, "supplier").agg(F.max("s_suppkey")).first()[0])
    found = CP.CheckpointProvider(spark, _batches(spark, sf), partial=True).rows(["3", "26", "9999999", last])
    return found.select("ticker", "status", F.get_json_object("payload", "$.s_name").alias("name"))
