"""Queries of filings: cleaned pages, sections, units, chunks and their audits, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlspike.operators import filings as FL
from marlspike.sources import sinks
from marlspike.sources.tables import table

from .registry import query

HEADINGS = ["Part I", "Item 1. Business", "Item 1A. Risk Factors", "Part II", "Item 7. Management", "Item 8. Statements"]
END = "SIGNATURES"


def _filings(spark, sf) -> DataFrame:
    """Documents as filings: headings stand before every other one of their first lines; every third begins with a table of contents; every fifth ends early; every 50th has none."""
    titles = F.array(*[F.lit(t) for t in HEADINGS[:-1]], F.when(F.col("doc_id") % 5 == 0, END).otherwise(HEADINGS[-1]))
    put = lambda x, i: F.when((i % 2 == 0) & (i < 2 * len(HEADINGS)), F.concat(F.get(titles, (i / 2).cast("int")), F.lit("\n"), x)).otherwise(x)
    text, i = F.coalesce("text", F.lit("")), F.col("doc_id")
    marked = F.array_join(F.transform(F.split(text, "\n"), put), "\n")
    body = F.when(i % 50 == 7, text).when(i % 3 == 0, F.concat(F.lit("\n".join(HEADINGS[:3]) + "\n"), marked)).otherwise(marked)
    return table(spark, sf, "documents").select(i.cast("string").alias("accession"), F.when(i % 2 == 0, "10-K").otherwise("10-Q").alias("form"), body.alias("text"), F.coalesce("source", F.lit("none")).alias("ticker"))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _squeezed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[ \t\r\f\x{{00a0}}]+', ' ', 'g'))"


_MARKED = f"array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: CASE WHEN (i - 1) % 2 = 0 AND i - 1 < {2 * len(HEADINGS)} THEN [{', '.join(_q(t) for t in HEADINGS[:-1])}, CASE WHEN doc_id % 5 = 0 THEN '{END}' ELSE '{HEADINGS[-1]}' END][(i - 1) // 2 + 1] || chr(10) || x ELSE x END), chr(10))"
_LINES = f"""f AS (SELECT doc_id::VARCHAR AS accession, CASE WHEN doc_id % 2 = 0 THEN '10-K' ELSE '10-Q' END AS form, coalesce(source, 'none') AS ticker,
 CASE WHEN doc_id % 50 = 7 THEN coalesce(text, '') WHEN doc_id % 3 = 0 THEN {_q(chr(10).join(HEADINGS[:3]) + chr(10))} || {_MARKED} ELSE {_MARKED} END AS text FROM documents),
l0 AS (SELECT accession, form, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line FROM f),
l1 AS (SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY accession ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start, {_squeezed('raw')} AS said FROM l0),
l2 AS (SELECT *, CASE WHEN said = '' THEN 0 ELSE len(string_split(said, ' ')) END AS words, CASE WHEN length(said) <= {FL.HEADING} THEN nullif(lower(regexp_extract(said, '{FL.PART}', 1)), '') END AS part, CASE WHEN length(said) <= {FL.HEADING} THEN nullif(lower(regexp_extract(said, '{FL.ITEM}', 1)), '') END AS item, length(said) <= {FL.HEADING} AND regexp_matches(said, '{FL.END}') AS ends FROM l1),
l3 AS (SELECT *, sum((part IS NOT NULL OR item IS NOT NULL OR ends)::INT) OVER w AS piece, coalesce(last_value(part IGNORE NULLS) OVER w, 'i') AS stated, TRY_CAST(regexp_extract(item, '^[0-9]+') AS INT) AS no FROM l2 WINDOW w AS (PARTITION BY accession ORDER BY line)),
l4 AS (SELECT *, CASE WHEN item IS NOT NULL THEN 'part-' || CASE WHEN form = '10-K' THEN CASE WHEN no < 5 THEN 'i' WHEN no < 10 THEN 'ii' WHEN no < 15 THEN 'iii' ELSE 'iv' END ELSE stated END || ':item-' || item END AS sec FROM l3),
lines AS MATERIALIZED (SELECT accession, line, said, char_start, length(raw) AS chars, words, piece, max(sec) OVER w AS section, max(CASE WHEN sec IS NOT NULL THEN said END) OVER w AS heading FROM l4 WINDOW w AS (PARTITION BY accession, piece)),
pieces AS (SELECT accession, piece, section, heading, min(char_start) AS char_start, max(char_start + chars) AS char_end, sum(words)::BIGINT AS words FROM lines WHERE section IS NOT NULL GROUP BY ALL),
secs AS MATERIALIZED (SELECT * EXCLUDE (anchor) FROM (SELECT *, max(CASE WHEN section = 'part-i:item-1' THEN piece END) OVER (PARTITION BY accession) AS anchor FROM pieces) WHERE anchor IS NULL OR piece >= anchor QUALIFY row_number() OVER (PARTITION BY accession, section ORDER BY words DESC, piece) = 1)"""
_SENTENCES = r"string_split(regexp_replace({0}, '([.!?]) ', '\1' || chr(10), 'g'), chr(10))"
_UNITS = f"""u0 AS (SELECT accession, piece, section, line, char_start, char_start + chars AS char_end, CASE WHEN words <= {FL.MOST} THEN [said] ELSE flatten(list_transform({_SENTENCES.format('said')}, lambda s: CASE WHEN len(string_split(s, ' ')) <= {FL.MOST} THEN [s]
 ELSE list_transform(range(0, greatest(ceil((len(string_split(s, ' ')) - {FL.WINDOW}) / {FL.STRIDE}.0), 0)::BIGINT + 1), lambda i: array_to_string(string_split(s, ' ')[i * {FL.STRIDE} + 1 : i * {FL.STRIDE} + {FL.WINDOW}], ' ')) END)) END AS parts
 FROM lines JOIN secs USING (accession, piece, section) WHERE lines.words > 0)""".replace("char_start, char_start + chars", "lines.char_start, lines.char_start + chars").replace("words <=", "lines.words <=") + f""",
u1 AS (SELECT accession, piece, section, line, char_start, char_end, unnest(parts) AS unit, unnest(range(len(parts))) AS k FROM u0),
u2 AS (SELECT *, row_number() OVER (PARTITION BY accession, piece ORDER BY line, k) AS nth, len(string_split(unit, ' ')) AS n, {_SENTENCES.format('unit')}[-1] AS last FROM u1),
u AS MATERIALIZED (SELECT *, CASE WHEN len(string_split(last, ' ')) <= {FL.OVERLAP} THEN len(string_split(last, ' ')) ELSE 0 END AS tail FROM u2)"""
_CHUNKS = f"""RECURSIVE_MARK {_LINES}, {_UNITS},
fold AS (SELECT accession, piece, nth, n AS held, tail AS before, 0 AS sequence FROM u WHERE nth = 1
 UNION ALL SELECT u.accession, u.piece, u.nth, CASE WHEN fold.held >= {FL.TARGET} OR fold.held + u.n > {FL.MOST} THEN CASE WHEN fold.before + u.n <= {FL.MOST} THEN fold.before ELSE 0 END + u.n ELSE fold.held + u.n END, u.tail, fold.sequence + (fold.held >= {FL.TARGET} OR fold.held + u.n > {FL.MOST})::INT
 FROM fold JOIN u ON u.accession = fold.accession AND u.piece = fold.piece AND u.nth = fold.nth + 1),
c0 AS (SELECT u.*, sequence, lag(tail) OVER w AS bef, lag(last) OVER w AS lap, sum(n) OVER w - n AS word_start FROM u JOIN fold USING (accession, piece, nth) WINDOW w AS (PARTITION BY accession, piece ORDER BY nth)),
c1 AS (SELECT *, sum(n) OVER (PARTITION BY accession, piece, sequence) AS held, max(sequence) OVER (PARTITION BY accession, piece) AS most FROM c0),
c2 AS (SELECT * REPLACE (CASE WHEN sequence = most AND sequence > 0 AND held < {FL.TAIL} THEN sequence - 1 ELSE sequence END AS sequence) FROM c1),
c3 AS (SELECT accession, piece, section, sequence, arg_min(bef, nth) AS bef, arg_min(lap, nth) AS lap, arg_min(n, nth) AS fn, sum(n) AS n, min(word_start) AS word_start, max(word_start + n) AS word_end, min(char_start) AS char_start, max(char_end) AS char_end, string_agg(unit, ' ' ORDER BY nth) AS body FROM c2 GROUP BY ALL),
c4 AS (SELECT *, CASE WHEN sequence > 0 AND bef + fn <= {FL.MOST} THEN bef ELSE 0 END AS overlap_words, count(*) OVER (PARTITION BY accession, section) AS s, count(*) OVER (PARTITION BY accession) AS a FROM c3),
c5 AS (SELECT *, CASE WHEN overlap_words > 0 THEN lap || ' ' || body ELSE body END AS text FROM c4 WHERE NOT (a >= {FL.ENOUGH} AND s > {FL.DOMINANT} * a)),
c6 AS (SELECT *, substr(sha256(accession || ':' || section || ':' || substr(sha256(lower(text)), 1, 16)), 1, 24) AS chunk_id FROM c5),
chunks AS MATERIALIZED (SELECT accession, section, sequence, chunk_id, (n + overlap_words)::BIGINT AS n_words, overlap_words, word_start::BIGINT AS word_start, word_end::BIGINT AS word_end, char_start, char_end, lag(chunk_id) OVER w AS previous_id, lead(chunk_id) OVER w AS next_id, text FROM c6 WINDOW w AS (PARTITION BY accession ORDER BY piece, sequence))"""
_CHUNKS = _CHUNKS.replace("RECURSIVE_MARK", "WITH RECURSIVE")


def _markup() -> str:
    body = "coalesce(html, '')"
    for pattern, put in FL.MARKUP:
        body = f"regexp_replace({body}, {_q(pattern)}, {'chr(10)' if put == chr(10) else _q(put)}, 'g')"
    for name, put in FL.ENTITIES.items():
        body = f"replace({body}, {_q(name)}, {_q(put)})"
    return body


@query(f"""WITH l AS (SELECT page_id, {_squeezed('unnest(string_split(body, chr(10)))')} AS said, unnest(range(len(string_split(body, chr(10))))) AS line FROM (SELECT page_id, {_markup()} AS body FROM pages)),
k AS (SELECT *, count(*) OVER (PARTITION BY page_id, regexp_replace(said, '[0-9]+', '#', 'g')) AS times FROM l WHERE said <> '' AND NOT regexp_matches(said, '{FL.FURNITURE}')),
t AS (SELECT page_id, string_agg(said, chr(10) || chr(10) ORDER BY line) AS text FROM k WHERE times < 4 OR length(said) >= 120 GROUP BY page_id) SELECT page_id, coalesce(t.text, '') AS text FROM pages LEFT JOIN t USING (page_id)""")
def html_clean(spark, sf):
    return FL.clean_html(table(spark, sf, "pages"))


@query(f"WITH {_LINES} SELECT accession, section, heading, char_start, char_end, words FROM secs")
def sections(spark, sf):
    return FL.detect_sections(_filings(spark, sf)).drop("piece")


@query(f"WITH {_LINES}, {_UNITS} SELECT accession, section, nth, n, md5(unit) AS unit_md5 FROM u")
def section_units(spark, sf):
    return FL.units(_filings(spark, sf)).select("accession", "section", "nth", "n", F.md5("unit").alias("unit_md5"))


@query(_CHUNKS + " SELECT * FROM chunks")
def chunk_documents(spark, sf):
    return FL.chunk_filings(_filings(spark, sf))


@query(_CHUNKS + f""", c AS (SELECT *, lead(chunk_id) OVER w AS after, lag(word_end) OVER (PARTITION BY accession, section ORDER BY sequence) AS before FROM chunks WINDOW w AS (PARTITION BY accession ORDER BY char_start, char_end, section, sequence))
SELECT count(*) AS chunks, count(DISTINCT chunk_id) AS ids, count(*) FILTER (n_words > {FL.MOST + FL.OVERLAP}) AS too_long, count(*) FILTER (char_end <= char_start OR word_end <= word_start) AS backwards, count(*) FILTER (before <> word_start) AS gaps, count(*) FILTER (after IS DISTINCT FROM next_id) AS broken_links, max(n_words) AS longest, sum(overlap_words)::BIGINT AS overlap_words FROM c""")
def audit_chunks(spark, sf):
    """How many chunks and ids there are, and how many chunks are too long, run backwards, leave a gap or have a link that doesn't meet its neighbour."""
    c = FL.chunk_filings(_filings(spark, sf))
    place, own = Window.partitionBy("accession").orderBy("char_start", "char_end", "section", "sequence"), Window.partitionBy("accession", "section").orderBy("sequence")
    c = c.withColumn("after", F.lead("chunk_id").over(place)).withColumn("before", F.lag("word_end").over(own))
    return c.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("chunk_id").alias("ids"), F.count_if(F.col("n_words") > FL.MOST + FL.OVERLAP).alias("too_long"), F.count_if((F.col("char_end") <= F.col("char_start")) | (F.col("word_end") <= F.col("word_start"))).alias("backwards"),
                 F.count_if(F.col("before") != F.col("word_start")).alias("gaps"), F.count_if(~F.col("after").eqNullSafe(F.col("next_id"))).alias("broken_links"), F.max("n_words").alias("longest"), F.sum("overlap_words").cast("bigint").alias("overlap_words"))


@query(_CHUNKS + ", c AS (SELECT form, section, n_words, row_number() OVER (PARTITION BY form, section ORDER BY n_words) AS r, count(*) OVER (PARTITION BY form, section) AS n FROM chunks JOIN f USING (accession)) SELECT form, section, max(n) AS chunks, min(n_words) AS fewest, min(n_words) FILTER (r = n // 2 + 1) AS median, max(n_words) AS most FROM c GROUP BY form, section")
def chunk_distribution(spark, sf):
    """Fewest, upper median and most words of the chunks of each form and section."""
    f = _filings(spark, sf)
    c = FL.chunk_filings(f).join(f.select("accession", "form"), "accession")
    # lengths are few numbers, so they are counted first: the upper median is the first whose running count passes half
    g = c.groupBy("form", "section", "n_words").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("form", "section")
    g = g.withColumn("upto", F.sum("c").over(w.orderBy("n_words"))).withColumn("chunks", F.sum("c").over(w))
    return g.groupBy("form", "section").agg(F.max("chunks").alias("chunks"), F.min("n_words").alias("fewest"), F.min(F.when(F.col("upto") > F.floor(F.col("chunks") / 2), F.col("n_words"))).alias("median"), F.max("n_words").alias("most"))


@query(_CHUNKS + ", t AS (SELECT accession AS ticker, count(*) AS documents FROM chunks GROUP BY accession) SELECT accession AS ticker, coalesce(documents, 0) AS documents, CASE WHEN documents IS NULL THEN 'NO_SEARCHABLE_FILING_CHUNKS' END AS message FROM f LEFT JOIN t ON t.ticker = f.accession")
def filing_index_errors(spark, sf):
    """Each filing's number of chunks, or an error where there is nothing to index."""
    f = _filings(spark, sf).drop("ticker").withColumn("ticker", F.col("accession"))
    return FL.index_or_error(f, FL.chunk_filings(f).withColumn("ticker", F.col("accession")))


@query(_CHUNKS + """, c AS (SELECT DISTINCT ticker, chunk_id FROM chunks JOIN f USING (accession)), p4 AS (SELECT ticker, substr(chunk_id, 1, 4) AS a, count(*) AS n, sha256(string_agg(chunk_id, chr(10) ORDER BY chunk_id)) AS part FROM c GROUP BY ALL), p2 AS (SELECT ticker, substr(a, 1, 2) AS a, sum(n) AS n, sha256(string_agg(part, chr(10) ORDER BY p4.a)) AS part FROM p4 GROUP BY ticker, substr(p4.a, 1, 2))
SELECT ticker, sum(n)::BIGINT AS chunks, sha256(string_agg(part, chr(10) ORDER BY a)) AS ids_sha FROM p2 GROUP BY ticker""")
def chunk_manifest(spark, sf):
    """Each ticker's chunks and a hash of their ids."""
    f = _filings(spark, sf)
    return sinks.manifest(FL.chunk_filings(f).join(f.select("accession", "ticker"), "accession"))
