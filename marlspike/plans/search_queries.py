"""Queries over documents, pages, vectors and conversations: index, retrieval, question answering parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlspike.functions.exprs import STOPWORDS, search_tokens, token_set
from marlspike.operators import search as R
from marlspike.operators.ranks import neighbours
from marlspike.sources.scratch import written
from marlspike.sources.tables import table

from .domain import corpus
from .registry import query

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
TOK = "list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+(?:''[a-z]+)?'), lambda x: length(x) > 1 AND NOT list_contains(" + _STOP + ", x))"
INDEX = f"""tok AS MATERIALIZED (SELECT doc_id, source AS ticker, lang AS form, {TOK.format('text')} AS terms FROM documents), live AS (SELECT *, len(terms) AS len FROM tok WHERE len(terms) > 0),
post AS MATERIALIZED (SELECT doc_id, ticker, form, len, term, count(*) AS tf FROM (SELECT doc_id, ticker, form, len, unnest(terms) AS term FROM live) GROUP BY ALL), stats AS (SELECT count(*) AS n_docs, round(avg(len), 4) AS avg_len FROM live)"""
QUERY_TERMS = f"qt AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({TOK.format('text')}) AS term FROM benchmark) GROUP BY ALL)"


def _bm(extra: str = "") -> str:
    return f"""WITH {INDEX}, {QUERY_TERMS}, dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS (SELECT q.query_id, p.doc_id, round(sum(times * ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 5) AS score FROM post p JOIN dfs USING (term) JOIN qt q USING (term), stats {extra} GROUP BY 1, 2)"""


def _queries(spark, sf) -> DataFrame:
    """All test items as questions."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(f"SELECT doc_id, len(t) AS n_terms, coalesce(t[1], '') AS first_term, coalesce(t[-1], '') AS last_term FROM (SELECT doc_id, {TOK.format('text')} AS t FROM documents)")
def tokenize(spark, sf):
    t = search_tokens("text")
    return corpus(spark, sf).select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("bigint").alias("n_terms"), F.coalesce(F.get("t", F.lit(0)), F.lit("")).alias("first_term"), F.coalesce(F.try_element_at("t", F.lit(-1)), F.lit("")).alias("last_term"))


@query(f"WITH {INDEX} SELECT doc_id, term, tf FROM post WHERE tf >= 3")
def term_freq(spark, sf):
    return R.postings(corpus(spark, sf)).where("tf >= 3").select("doc_id", "term", "tf")


@query(f"WITH {INDEX} SELECT term, count(*) AS df FROM post GROUP BY term HAVING count(*) >= 5")
def doc_freq(spark, sf):
    return R.postings(corpus(spark, sf)).groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df >= 5")


@query(f"WITH {INDEX} SELECT * FROM stats")
def corpus_stats(spark, sf):
    return R.corpus_stats(corpus(spark, sf))


@query(_bm() + " SELECT query_id, doc_id, score FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10")
def bm25_topk(spark, sf):
    return R.bm25_top(corpus(spark, sf), _queries(spark, sf), 10).drop("rank")


@query(_bm("WHERE form = 'en'") + " SELECT query_id, doc_id, score FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 5")
def bm25_filtered(spark, sf):
    return R.bm25_top(corpus(spark, sf), _queries(spark, sf), 5, keep=F.col("form") == "en").drop("rank")


@query("SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(list_transform(e.embedding, lambda x: x::DOUBLE), list_transform(q.embedding, lambda x: x::DOUBLE)), 6) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, e.vec_id) <= 10")
def cosine_topk(spark, sf):
    """The vectors whose id is divisible by 100 against all."""
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return R.vector_top(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), q, 10).drop("rank")


@query(_bm() + ", t AS (SELECT * FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 12) SELECT query_id, doc_id, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END, 4) AS norm FROM t WINDOW w AS (PARTITION BY query_id)")
def minmax_normalize(spark, sf):
    t = R.bm25_top(corpus(spark, sf), _queries(spark, sf), 12)
    return R.minmax(t, "score", "norm").select("query_id", "doc_id", F.round("norm", 4).alias("norm"))


@query(_bm() + """, lex AS (SELECT * FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 12), sem AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(list_transform(e.embedding, lambda x: x::DOUBLE), list_transform(q.embedding, lambda x: x::DOUBLE)), 6) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, e.vec_id) <= 12),
nl AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS x FROM lex WINDOW w AS (PARTITION BY query_id)), ns AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS x FROM sem WINDOW w AS (PARTITION BY query_id))
SELECT query_id, doc_id, round(0.6::DOUBLE * coalesce(nl.x, 0) + 0.4::DOUBLE * coalesce(ns.x, 0), 4) AS score FROM nl FULL JOIN ns USING (query_id, doc_id)""")
def hybrid_fuse(spark, sf):
    lex = R.minmax(R.bm25_top(corpus(spark, sf), _queries(spark, sf), 12), "score", "x").select("query_id", "doc_id", "x")
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    sem = R.minmax(R.vector_top(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), q, 12), "score", "y").select("query_id", "doc_id", "y")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return lex.join(sem, ["query_id", "doc_id"], "full_outer").select("query_id", "doc_id", F.round(0.6 * zero("x") + 0.4 * zero("y"), 4).alias("score"))


@query(_bm() + ", t AS (SELECT bm.*, quality = 1 AS good, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bm.doc_id) AS r FROM bm LEFT JOIN labels USING (doc_id)) SELECT query_id, round(count(*) FILTER (good AND r <= 3) / 3.0::DOUBLE, 6) AS p3, round(coalesce(1.0::DOUBLE / min(r) FILTER (good), 0), 6) AS rr FROM t WHERE r <= 10 GROUP BY query_id")
def precision_mrr(spark, sf):
    t = R.bm25_top(corpus(spark, sf), _queries(spark, sf), 10).join(table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("good")), "doc_id", "left")
    return t.groupBy("query_id").agg(F.round(F.count_if(F.col("good") & (F.col("rank") <= 3)) / 3.0, 6).alias("p3"), F.round(F.coalesce(1.0 / F.min(F.when(F.col("good"), F.col("rank"))), F.lit(0.0)), 6).alias("rr"))


@query("SELECT doc_id, substr(sha256(doc_id::VARCHAR || ':' || substr(sha256(text), 1, 16)), 1, 24) AS chunk_id FROM documents")
def chunk_ids_sha(spark, sf):
    digest = F.substring(F.sha2("text", 256), 1, 16)
    return corpus(spark, sf).select("doc_id", F.substring(F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), digest), 256), 1, 24).alias("chunk_id"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT line, count(*) AS n FROM l GROUP BY line) SELECT line, n FROM c WHERE n >= 4 AND length(line) < 120")
def repeated_line_filter(spark, sf):
    lines = corpus(spark, sf).select(F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= 4) & (F.length("line") < 120))


@query("SELECT source, lang, share FROM (SELECT source, lang, round(count(*) / sum(count(*)) OVER (PARTITION BY source)::DOUBLE, 6) AS share, sum(count(*)) OVER (PARTITION BY source) AS n FROM documents GROUP BY 1, 2) WHERE share > 0.5 AND n >= 10")
def dominant_section_drop(spark, sf):
    c = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("c")).withColumn("n", F.sum("c").over(Window.partitionBy("source")))
    return c.withColumn("share", F.round(F.col("c") / F.col("n"), 6)).where("share > 0.5 and n >= 10").select("source", "lang", "share")


@query("SELECT doc_id, lag(doc_id) OVER w AS previous_id, lead(doc_id) OVER w AS next_id FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def prev_next_links(spark, sf):
    return neighbours(table(spark, sf, "documents"), "source", "doc_id").withColumnsRenamed({"previous": "previous_id", "next": "next_id"})


def _chosen(listed: str, k: int) -> str:
    """SQL of the chosen of ``listed(query_id, doc_id, score, section, words)``: the candidates are offered twice, one after another."""
    return f"""cand AS MATERIALIZED (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY query_id) AS n, max(score) OVER (PARTITION BY query_id) AS best FROM {listed} WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, doc_id)),
div AS (SELECT query_id, 1::BIGINT AS step, [{{'doc_id': doc_id, 'section': section, 'words': words}}] AS picked FROM cand WHERE pos = 1
 UNION ALL SELECT d.query_id, d.step + 1, CASE WHEN len(d.picked) < {k} AND len(list_filter(d.picked, lambda a: a.doc_id = c.doc_id OR len(list_intersect(a.words, c.words)) > 0.7::DOUBLE * len(list_distinct(list_concat(a.words, c.words))) OR len(list_concat(a.words, c.words)) = 0)) = 0
  AND (d.step >= c.n OR c.score >= 0.25::DOUBLE * c.best AND len(list_filter(d.picked, lambda a: a.section IS NOT DISTINCT FROM c.section)) = 0) THEN list_append(d.picked, {{'doc_id': c.doc_id, 'section': c.section, 'words': c.words}}) ELSE d.picked END
 FROM div d JOIN cand c ON c.query_id = d.query_id AND c.pos = d.step % c.n + 1 WHERE d.step < 2 * c.n),
chosen AS (SELECT query_id, unnest(picked).doc_id AS doc_id, unnest(range(1, len(picked) + 1)) AS place FROM (SELECT query_id, arg_max(picked, step) AS picked FROM div GROUP BY query_id))"""


_WORDS = "list_distinct(regexp_extract_all(lower(coalesce(d.text, '')), '[a-z0-9]+(?:''[a-z]+)?'))"


@query(_bm().replace("WITH ", "WITH RECURSIVE ", 1) + f", t AS (SELECT bm.*, d.source AS section, {_WORDS} AS words FROM bm JOIN documents d USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 12), {_chosen('t', 5)} SELECT query_id, doc_id, place FROM chosen")
def diversify_topk(spark, sf):
    docs = corpus(spark, sf)
    return R.diversify(R.with_columns_of(R.bm25_top(docs, _queries(spark, sf), 12), docs.select("doc_id", F.col("ticker").alias("section"), "text")), 5)


_LIKE_THIS = f"qt AS (SELECT doc_id AS query_id, term, count(*) AS times FROM (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents WHERE doc_id % 100 = 0) GROUP BY ALL)"
_HYBRID = _bm().replace(QUERY_TERMS, _LIKE_THIS) + """, lex AS (SELECT * FROM bm WHERE query_id <> doc_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 12),
sem AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(list_transform(e.embedding, lambda x: x::DOUBLE), list_transform(q.embedding, lambda x: x::DOUBLE)), 6) AS score FROM (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)) e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0 AND vec_id IN (SELECT doc_id FROM documents)) q WHERE e.vec_id <> q.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, e.vec_id) <= 12),
flt AS (SELECT doc_id AS query_id, CASE WHEN vec_id IS NULL THEN 'NOT_EMBEDDED' END AS fault FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE doc_id % 100 = 0),
nl AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS x FROM lex WINDOW w AS (PARTITION BY query_id)), ns AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS x FROM sem WINDOW w AS (PARTITION BY query_id)),
fused AS (SELECT query_id, doc_id, round(CASE WHEN fault IS NULL THEN 0.6::DOUBLE * coalesce(nl.x, 0) + 0.4::DOUBLE * coalesce(ns.x, 0) ELSE coalesce(nl.x, 0) END, 4) AS score, CASE WHEN fault IS NULL THEN 'hybrid' ELSE 'lexical' END AS mode, fault AS warning FROM nl FULL JOIN ns USING (query_id, doc_id) LEFT JOIN flt USING (query_id))"""


def _hybrid(spark, sf) -> DataFrame:
    """Documents like those whose id is divisible by 100: by their terms, and by their vectors where they have one."""
    docs, e = corpus(spark, sf), table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    asked = docs.where("doc_id % 100 = 0")
    lex = R.bm25_top(docs, asked.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")), 12, itself=False)
    e = e.join(docs.select("doc_id"), "doc_id", "left_semi")
    q = e.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("vector").alias("q"))
    sem = R.top_k(R.vector_top(e, q, 13).where("query_id <> doc_id").drop("rank"), 12)
    faults = asked.join(q.select(F.col("query_id").alias("doc_id"), F.lit(True).alias("has")), "doc_id", "left").select(F.col("doc_id").alias("query_id"), F.when(F.col("has").isNull(), "NOT_EMBEDDED").alias("fault"))
    return R.hybrid(lex, sem, faults)


@query(_HYBRID + " SELECT * FROM fused")
def hybrid_search(spark, sf):
    """Both lists fused in one space of ids; queries without a vector keep the lexical list, with a warning."""
    return _hybrid(spark, sf)


@query(_HYBRID.replace("WITH ", "WITH RECURSIVE ", 1) + f", t AS (SELECT query_id, f.doc_id, score, d.source AS section, {_WORDS} AS words FROM fused f JOIN documents d USING (doc_id)), {_chosen('t', 5)} SELECT query_id, doc_id, place, mode FROM chosen JOIN fused USING (query_id, doc_id)")
def hybrid_diversified(spark, sf):
    """The fused lists' five results of each query that are unlike one another."""
    fused = written(_hybrid(spark, sf), "fused")
    docs = corpus(spark, sf).select("doc_id", F.col("ticker").alias("section"), "text")
    return R.diversify(R.with_columns_of(fused, docs), 5).join(fused.select("query_id", "doc_id", "mode"), ["query_id", "doc_id"])


_KW = "".join(f" WHEN {' OR '.join(f"contains(q, '{w}')" for w in ws)} THEN '{n}'" for n, ws in R.KEYWORDS.items())


@query(f"SELECT conv_id, turn, CASE WHEN regexp_matches(q, '{'|'.join(R.OUTLOOK)}') THEN 'risk_outlook'{_KW} ELSE 'general' END AS intent FROM (SELECT conv_id, turn, lower(text) || CASE conv_id % 5 WHEN 0 THEN ' will it go up' WHEN 1 THEN ' the gross margin' WHEN 2 THEN ' is it cheap' ELSE '' END AS q FROM conversations)")
def intent_detect(spark, sf):
    tail = F.when(F.col("conv_id") % 5 == 0, " will it go up").when(F.col("conv_id") % 5 == 1, " the gross margin").when(F.col("conv_id") % 5 == 2, " is it cheap").otherwise("")
    return table(spark, sf, "conversations").select("conv_id", "turn", R.intent(F.concat("text", tail)).alias("intent"))


@query("WITH b AS (SELECT conv_id, turn, text, sum(length(text)) OVER w AS used, row_number() OVER w AS nth FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)) SELECT conv_id, turn, length(substr(text, 1, 400)) AS kept_chars FROM b WHERE used <= 400 OR nth = 1")
def prompt_pack_budget(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("prompt"), F.struct("turn", "role").alias("place"), F.col("text").alias("body"))
    return R.prompt_pack(c, 400).select(F.col("prompt").alias("conv_id"), "place.turn", F.length("body").cast("bigint").alias("kept_chars"))


@query(_bm() + " SELECT doc_id, max(score) AS score FROM bm GROUP BY doc_id HAVING max(score) > 5")
def evidence_merge(spark, sf):
    return R.bm25_best(corpus(spark, sf), _queries(spark, sf)).where("score > 5")


_SET = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z]+)?'))"


@query(f"WITH s AS (SELECT item_id, {_SET} AS t FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE, 6) AS sim FROM s a JOIN s b ON a.item_id % 100 = 0 AND a.item_id <> b.item_id WHERE len(list_intersect(a.t, b.t)) > 0")
def jaccard_pairs(spark, sf):
    """The items whose id is divisible by 100 against all others that share a token."""
    s = table(spark, sf, "benchmark").select("item_id", token_set("text").alias("t"))
    t = s.select("item_id", F.size("t").alias("n"), F.explode("t").alias("token"))
    a, b = t.where("item_id % 100 = 0").select(F.col("item_id").alias("a"), F.col("n").alias("na"), "token"), t.select(F.col("item_id").alias("b"), F.col("n").alias("nb"), "token")
    both = b.join(a, "token").where("a <> b").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("both"))
    return both.select("a", "b", F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 6).alias("sim"))


@query(_bm() + ", t AS (SELECT * FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 3) SELECT query_id, doc_id, string_agg(term, ',' ORDER BY term) AS matched FROM t JOIN qt USING (query_id) JOIN post USING (doc_id, term) GROUP BY 1, 2")
def bm25_matched_terms(spark, sf):
    docs, q = corpus(spark, sf), _queries(spark, sf)
    top = written(R.bm25_top(docs, q, 3), "found")
    return R.matched_terms(docs, q, top).select("query_id", "doc_id", F.array_join("matched", ",").alias("matched"))


@query(f"SELECT item_id, array_to_string(list_sort(list_distinct(list_concat({TOK.format('substr(q, 1, 200)')}, " + ", ".join(f"CASE WHEN regexp_matches(lower(q), '{p}') THEN {w} ELSE [] END" for p, w in R.PROFILES) + "))), ',') AS terms FROM (SELECT item_id, text || CASE item_id % 4 WHEN 0 THEN ' debt' WHEN 1 THEN ' supply chain risk' ELSE '' END AS q FROM benchmark)")
def expanded_terms(spark, sf):
    k = F.col("item_id") % 4
    q = F.concat("text", F.when(k == 0, " debt").when(k == 1, " supply chain risk").otherwise(""))
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.array_sort(R.expanded_terms(q)), ",").alias("terms"))
