"""Queries of the universe's modes and of the sortable screen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspike.operators import screen as V
from marlspike.operators import universe as U
from marlspike.sources.scratch import written
from marlspike.sources.tables import table

from .domain import BARS, SECURITIES, bars, securities
from .fact_queries import SCORED, _scored
from .price_queries import _trend, trend_sql
from .registry import query

#: (mode, limit, offset, exchange, with the seed companies)
_BUILDS = [("nyse_nasdaq_core", None, 0, None, False), ("nyse", 40, 5, None, False), ("nasdaq", 60, 0, None, True), ("sec_listed_all", None, 10, "otc", True)]


def _records(spark, sf) -> DataFrame:
    size = F.col("p_size")
    ticker = F.concat(F.substring("p_name", 1, 4), F.when(size % 5 == 0, ".W").when(size % 5 == 1, "").otherwise((F.col("p_partkey") % 400).cast("string")))
    where = F.when(size % 4 == 0, "Nyse").when(size % 4 == 1, "NASDAQ").when(size % 4 == 2, "OTC")
    return table(spark, sf, "part").select((F.col("p_partkey") % 7).alias("cik"), ticker.alias("ticker"), F.concat("p_name", F.when(size % 7 == 0, " Trust").otherwise("")).alias("name"), where.alias("exchange"), F.col("p_partkey").alias("place"))


_RECORDS = """recs AS (SELECT *, lpad(cik0, 10, '0') || ':' || ticker AS key, CASE WHEN reason IS NULL THEN 100 WHEN reason = 'exchange' THEN 700 ELSE 900 END AS priority FROM (SELECT *, CASE WHEN length(ticker) >= 5 AND regexp_matches(ticker, '[RUW]$') THEN 'suffix' WHEN regexp_matches(upper(name), '\\b(?:ACQUISITION|CAPITAL|SPONSOR|BLANK CHECK)\\b') AND regexp_matches(ticker, '[RUW]$') THEN 'spac'
 WHEN regexp_matches(ticker, '-(?:W|WS|WTS?|R|RT|U|UN|UT|UNIT|P[A-Z]?|PR[A-Z]?)$') THEN 'class' WHEN regexp_matches(upper(name), '\\b(?:ETF|ETN|FUND|TRUST|SPAC|RIGHTS?|UNIT|PREFERRED)\\b|\\bWARRANT') THEN 'fund' WHEN upper(coalesce(exchange, 'NYSE')) NOT IN ('NYSE', 'NASDAQ', 'NYSE AMERICAN') THEN 'exchange' END AS reason
 FROM (SELECT p_partkey AS place, (p_partkey % 7)::VARCHAR AS cik0, replace(upper(trim(substr(p_name, 1, 4) || CASE p_size % 5 WHEN 0 THEN '.W' WHEN 1 THEN '' ELSE (p_partkey % 400)::VARCHAR END)), '.', '-') AS ticker, p_name || CASE p_size % 7 WHEN 0 THEN ' Trust' ELSE '' END AS name, CASE p_size % 4 WHEN 0 THEN 'Nyse' WHEN 1 THEN 'NASDAQ' WHEN 2 THEN 'OTC' END AS exchange FROM part)))"""
_SEED = "seed AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c.zfill(10)}:{t}', {i})" for i, (t, c, *_) in enumerate(U.SEED)) + ") v(ticker, key, place))"


def _page_sql(name: str, rows: str, limit: int | None, offset: int) -> str:
    """Rows of a page; ``k`` counts within the supported and within the others."""
    numbered = f"{name}n AS (SELECT *, row_number() OVER (PARTITION BY supported ORDER BY origin, priority, ticker, place) AS k, count(*) FILTER (supported) OVER () AS ns FROM {rows})"
    keep = f"supported AND k > {offset} OR NOT supported" if limit is None else f"supported AND k > {offset} AND k <= {offset + limit} OR NOT supported AND k <= {limit} - least({limit}, greatest(0, ns - {offset}))"
    return f"{numbered}, {name} AS (SELECT key, ticker, place, priority, supported, exclude_reason, origin FROM {name}n WHERE {keep})"


def _build_sql(i: int, mode: str, limit: int | None, offset: int, exchange: str | None, starter: bool) -> str:
    wanted = [x for x in (exchange, mode if mode in ("nyse", "nasdaq") else None) if x]
    where = " AND ".join([f"upper(exchange) = '{x.upper()}'" for x in wanted] or ["true"])
    out = f"d{i} AS (SELECT key, ticker, place, priority, CASE WHEN row_number() OVER (PARTITION BY key ORDER BY place) > 1 THEN 'duplicate' ELSE reason END AS exclude_reason FROM recs WHERE {where}), r{i} AS (SELECT key, ticker, place, priority, exclude_reason IS NULL AS supported, exclude_reason, 1 AS origin FROM d{i}), "
    out += _page_sql(f"p{i}", f"r{i}", limit + len(U.SEED) if starter and limit else limit, offset)
    if starter:
        out += f", s{i} AS (SELECT key, ticker, place, 0 AS priority, true AS supported, NULL::VARCHAR AS exclude_reason, 0 AS origin FROM seed UNION ALL (SELECT key, ticker, place, priority, supported, exclude_reason, origin FROM p{i} WHERE ticker NOT IN (SELECT ticker FROM seed) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY NOT supported, priority, place) = 1)), " + _page_sql(f"f{i}", f"s{i}", limit, 0)
    return out


_SHOWN = ["key", "ticker", "place", "priority", "supported", "exclude_reason", "origin"]


@query(f"WITH {_RECORDS}, {_SEED}, " + ", ".join(_build_sql(i, *b) for i, b in enumerate(_BUILDS)) + " " + " UNION ALL ".join(f"SELECT '{b[0]}' AS mode, {', '.join(_SHOWN)} FROM {'f' if b[4] else 'p'}{i}" for i, b in enumerate(_BUILDS)))
def universe_modes(spark, sf):
    """The universe in several modes: whole, one exchange's page, and with the seed companies in front."""
    records = _records(spark, sf)
    made = [U.build(spark, mode, records, limit, offset, exchange, starter).select(F.lit(mode).alias("mode"), *_SHOWN) for mode, limit, offset, exchange, starter in _BUILDS]
    return reduce(DataFrame.unionByName, made)


#: (sort key, descending, page, rows of a page, signal, exchange); the last asks for a page that isn't there.
_PAGES = [(k, i % 2 == 1, 1, 7, "all", "all") for i, k in enumerate(V.KEYS)] + [("value", False, 2, 5, "all", "all"), ("price", True, 99, 3, "neutral", "ASIA")]
_ROW = ["ticker", "sector", "exchange", "signal", "confidence", "value", "quality", "momentum", "price", "trend", "trend_status"]


def _board(spark, sf) -> DataFrame:
    """A row for each series: its signal and scores, its security, last price and trend."""
    last = bars(spark, sf).where("idx = n - 1").select("ticker", "price")
    trend = _trend(spark, sf, False).select("ticker", F.round("score", 1).alias("trend"), F.col("status").alias("trend_status"))
    rows = _scored(spark, sf).select("ticker", "signal", "confidence", "value", "quality", "momentum").join(last, "ticker").join(securities(spark, sf), "ticker").join(trend, "ticker", "left")
    return written(rows.withColumn("name", F.concat(F.lit("Company "), F.col("ticker"))), "board")


def _ordered_sql(key: str, descending: bool) -> str:
    shown = "CASE confidence WHEN 'High' THEN 4 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 2 ELSE 1 END" if key == "confidence" else key if key in ("ticker", "price") else f"coalesce({key}, -1)"
    return f"{shown} {'DESC' if descending else 'ASC'}, ticker"


def _screen_sql(key, descending, number, size, signal, exchange) -> str:
    where = " AND ".join([f"{c} = '{v}'" for c, v in (("signal", signal), ("exchange", exchange)) if v != "all"] or ["true"])
    last = "greatest(1, ceil(n / {0}::DOUBLE))".format(size)
    return f"""SELECT '{key}' AS sorted_by, {str(descending).lower()} AS descending, least({number}, {last})::INT AS page, {last}::INT AS pages, k::INT AS place, ticker, signal, confidence FROM (SELECT *, row_number() OVER (ORDER BY {_ordered_sql(key, descending)}) AS k, count(*) OVER () AS n FROM board WHERE {where}) WHERE k > (least({number}, {last}) - 1) * {size} AND k <= least({number}, {last}) * {size}"""


@query(SCORED + ", " + trend_sql(False)[len(f"WITH {BARS}, "):] + f", {SECURITIES}, board AS MATERIALIZED (SELECT s.ticker, s.signal, s.confidence, s.value, s.quality, s.momentum, b.price, x.exchange, x.sector, round(t.score, 1) AS trend FROM scored s JOIN bars b ON b.ticker = s.ticker AND b.idx = b.n - 1 JOIN securities x ON x.ticker = s.ticker LEFT JOIN trend t ON t.ticker = s.ticker) " + " UNION ALL ".join(f"({_screen_sql(*p)})" for p in _PAGES))
def screen_pages(spark, sf):
    """Pages of the screen by each of the seven keys, and one past the last."""
    board, out = _board(spark, sf), []
    for key, descending, number, size, signal, exchange in _PAGES:
        rows, shown, pages = V.page(V.matching(board, signal=signal, exchange=exchange), key, descending, number, size)
        out.append(rows.select(F.lit(key).alias("sorted_by"), F.lit(descending).alias("descending"), F.lit(shown).alias("page"), F.lit(pages).alias("pages"), "place", "ticker", "signal", "confidence"))
    return reduce(DataFrame.unionByName, out)
