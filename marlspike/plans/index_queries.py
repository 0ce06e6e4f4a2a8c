"""Queries of the stored index: build, append, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlspike.operators import postings as P
from marlspike.sources.scratch import fresh_path

from .domain import corpus
from .registry import query
from .search_queries import INDEX, _bm, _queries


def _built(spark, sf, whole: bool = True) -> P.Index:
    """The corpus in an index; in parts: half of the tickers, a poorer text of three of these, and then all others with the right texts of the three."""
    docs, path = corpus(spark, sf), fresh_path(spark, "index")
    if whole:
        P.append(spark, path, docs)
        return P.Index(spark, path)
    half = F.pmod(F.crc32(F.col("ticker").cast("binary")), F.lit(2)) == 0
    again = F.pmod(F.crc32(F.col("ticker").cast("binary")), F.lit(6)) == 0
    P.append(spark, path, docs.where(half).withColumn("text", F.when(again, F.concat(F.lit("stale draft "), F.substring("text", 1, 50))).otherwise(F.col("text"))))
    P.append(spark, path, docs.where(again))
    P.append(spark, path, docs.where(~half))
    return P.Index(spark, path)


@query(f"WITH {INDEX} SELECT term, count(*) AS df, sum(tf)::BIGINT AS occurrences, max(tf)::BIGINT AS most, min(len)::BIGINT AS shortest, count(DISTINCT (ticker, doc_id // {P.SPAN})) AS blocks FROM post GROUP BY term")
def index_build(spark, sf):
    """Terms of a stored index: documents, occurrences, the bounds that its blocks keep, and how many blocks there are."""
    b = _built(spark, sf).blocks()
    return b.groupBy("term").agg(F.sum("n").cast("bigint").alias("df"), F.sum(F.aggregate("docs", F.lit(0).cast("bigint"), lambda s, d: s + d["tf"])).alias("occurrences"), F.max("max_tf").cast("bigint").alias("most"), F.min("min_len").cast("bigint").alias("shortest"), F.count(F.lit(1)).alias("blocks"))


@query(f"WITH {INDEX} SELECT ticker, count(*) AS n_docs, sum(len)::BIGINT AS n_terms, CASE WHEN h % 6 = 0 THEN 1 WHEN h % 2 = 0 THEN 0 ELSE 2 END AS batch FROM live JOIN (SELECT source AS ticker, any_value(CRC) AS h FROM documents JOIN crcs ON source = name GROUP BY 1) USING (ticker) GROUP BY ticker, h".replace("any_value(CRC)", "any_value(crc)").replace("WITH ", "WITH RECURSIVE crc_bits AS (SELECT name, x, n FROM (SELECT DISTINCT source AS name, 4294967295::BIGINT AS x, 0 AS n FROM documents) UNION ALL SELECT name, CASE WHEN n % 9 = 0 THEN xor(x, ascii(substr(name, n // 9 + 1, 1))::BIGINT) ELSE CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END END, n + 1 FROM crc_bits WHERE n < 9 * length(name)), crcs AS (SELECT name, xor(x, 4294967295::BIGINT) AS crc FROM crc_bits WHERE n = 9 * length(name)), "))
def index_append(spark, sf):
    """Tickers of an index that was built in three batches, one of which replaces documents: sizes as of the texts that count, and the batch of each."""
    return _built(spark, sf, whole=False).tickers.where("n_docs > 0").select("ticker", "n_docs", "n_terms", "batch")


@query(_bm() + " SELECT query_id, doc_id, score FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10")
def index_search(spark, sf):
    """BM25 through the stored index, built in batches: the same as over all documents."""
    return _built(spark, sf, whole=False).search(_queries(spark, sf), 10).drop("rank")
