"""The universe of companies: classified records, duplicates marked, one of eleven modes, the seed companies in front."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions.exprs import normalize_cik, normalize_ticker

from .refresh import limit_two_classes

# The seed companies (ticker, CIK, name, exchange, sector).
SEED = [
    ("AAPL", "320193", "Apple Inc.", "NASDAQ", "Technology"),
    ("MSFT", "789019", "Microsoft Corp.", "NASDAQ", "Technology"),
    ("GOOGL", "1652044", "Alphabet Inc.", "NASDAQ", "Communication Services"),
    ("AMZN", "1018724", "Amazon.com Inc.", "NASDAQ", "Consumer Discretionary"),
    ("JPM", "19617", "JPMorgan Chase & Co.", "NYSE", "Financials"),
    ("JNJ", "200406", "Johnson & Johnson", "NYSE", "Health Care"),
    ("XOM", "34088", "Exxon Mobil Corp.", "NYSE", "Energy"),
    ("F", "37996", "Ford Motor Co.", "NYSE", "Consumer Discretionary"),
    ("KO", "21344", "The Coca-Cola Co.", "NYSE", "Consumer Staples"),
    ("INTC", "50863", "Intel Corp.", "NASDAQ", "Technology"),
]
# The modes; the first five need no records.
SEEDED = ("starter", "watchlist", "custom", "sp500_or_largecap", "largecap")
MODES = (*SEEDED, "nyse", "nasdaq", "nyse_nasdaq_core", "sec_listed_core", "sec_listed_all", "sec_traceable_all")
COLUMNS = ["key", "ticker", "place", "name", "exchange", "priority", "supported", "exclude_reason", "origin"]

# Endings of tickers that are no common shares, words of names that are no operating companies.
TICKER_ENDINGS = ["W", "WS", "WTS?", "R", "RT", "U", "UN", "UT", "UNIT", "P[A-Z]?", "PR[A-Z]?"]
NAME_WORDS = [r"\bETF\b", r"\bETN\b", r"\bFUND\b", r"\bTRUST\b", r"\bSPAC\b", r"\bRIGHTS?\b", r"\bUNIT\b", r"\bPREFERRED\b", r"\bWARRANT"]


def classify(rows: DataFrame) -> DataFrame:
    """Adds exclude_reason (null: supported) and priority by ordered rules on ticker, name and exchange."""
    name, ticker = F.upper("name"), F.col("ticker")
    reason = F.when((F.length(ticker) >= 5) & ticker.rlike("[RUW]$"), "suffix").when(name.rlike(r"\b(?:ACQUISITION|CAPITAL|SPONSOR|BLANK CHECK)\b") & ticker.rlike("[RUW]$"), "spac")
    reason = reason.when(ticker.rlike(f"-(?:{'|'.join(TICKER_ENDINGS)})$"), "class").when(name.rlike("|".join(NAME_WORDS)), "fund")
    reason = reason.when(~F.upper(F.coalesce("exchange", F.lit("NYSE"))).isin("NYSE", "NASDAQ", "NYSE AMERICAN"), "exchange")
    return rows.withColumn("exclude_reason", reason).withColumn("priority", F.when(F.col("exclude_reason").isNull(), 100).when(F.col("exclude_reason") == "exchange", 700).otherwise(900))


def seed(spark: SparkSession, limit: int | None = None) -> DataFrame:
    """The seed companies as rows of a universe: supported, of priority 0, origin 0."""
    rows = [(*r[:4], i) for i, r in enumerate(SEED[:limit])]
    r = spark.createDataFrame(rows, "ticker string, cik string, name string, exchange string, place long")
    return r.select(F.concat_ws(":", normalize_cik("cik"), "ticker").alias("key"), "ticker", "place", "name", "exchange", F.lit(0).alias("priority"), F.lit(True).alias("supported"), F.lit(None).cast("string").alias("exclude_reason"), F.lit(0).alias("origin"))


def classified(records: DataFrame) -> DataFrame:
    """Rows of a universe from ``records(cik, ticker, name, exchange, place)``; ``place`` numbers them.

    Of the records with one CIK and ticker the first stays as it is; the others are kept, but not supported. The firsts are
    found by an aggregation and marked by place, so a key that a third of the records carry is no task's alone."""
    r = classify(records.select(normalize_cik("cik").alias("cik"), normalize_ticker("ticker").alias("ticker"), "name", "exchange", "place"))
    r = r.withColumn("key", F.concat_ws(":", "cik", "ticker"))
    firsts = r.groupBy("key").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    r = r.join(firsts, "place", "left").withColumn("exclude_reason", F.when(F.col("first"), F.col("exclude_reason")).otherwise("duplicate"))
    return r.withColumn("supported", F.col("exclude_reason").isNull()).withColumn("origin", F.lit(1)).select(*COLUMNS)


def page(rows: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """``limit`` supported rows from ``offset`` on, filled up by unsupported ones; without a limit all but the first ``offset`` supported."""
    order = ["origin", "priority", "ticker", "place"]
    if limit:
        return limit_two_classes(rows, limit, offset, order)
    if not offset:
        return rows
    skipped = rows.where("supported").orderBy(*order).limit(offset).select("origin", "place")
    return rows.join(skipped, ["origin", "place"], "left_anti").select(*rows.columns)


def after_starter(rows: DataFrame, starter: DataFrame, limit: int | None = None) -> DataFrame:
    """The starter rows, then the best row of each ticker that these don't have, within ``limit``."""
    best = F.min(F.struct((~F.col("supported")).alias("_u"), "priority", "place", *[c for c in rows.columns if c not in ("priority", "place", "ticker")]))
    others = rows.join(starter.select("ticker"), "ticker", "left_anti").groupBy("ticker").agg(best.alias("b")).select("ticker", "b.*").select(*rows.columns)
    return page(starter.unionByName(others), limit)


def build(spark: SparkSession, mode: str, records: DataFrame | None = None, limit: int | None = None, offset: int = 0, exchange: str | None = None, include_starter: bool = False) -> DataFrame:
    """The universe of a mode. The seeded modes are the seed companies where no records are given; the others need records.

    ``nyse`` and ``nasdaq`` keep one exchange's records, ``exchange`` any one's. With the starter as many more rows are read
    as it has, so that it takes no row's place."""
    if mode not in MODES:
        raise ValueError(f"unsupported universe mode: {mode}")
    if records is None:
        if mode not in SEEDED:
            raise ValueError(f"the mode {mode} needs records")
        return seed(spark, limit)
    for wanted in (exchange, mode if mode in ("nyse", "nasdaq") else None):
        if wanted:
            records = records.where(F.upper("exchange") == wanted.upper())
    rows = page(classified(records), limit + len(SEED) if include_starter and limit else limit, offset)
    return after_starter(rows, seed(spark), limit) if include_starter else rows
