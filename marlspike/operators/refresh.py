"""Incremental refresh: a rotating batch of the universe, merges that keep order, statuses and manifests that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import row_number


def fingerprint(universe: DataFrame) -> str:
    """A hash of the supported rows' tickers and CIKs, whatever their order."""
    line = F.sha2(F.concat_ws("|", F.upper("ticker"), F.col("cik").cast("string")), 256)
    row = universe.agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring(line, 1, 15), 16, 10).cast("decimal(38,0)")).alias("s"), F.bit_xor(F.conv(F.substring(line, 16, 15), 16, 10).cast("long")).alias("x")).first()
    return f"{row['n']}-{row['s']}-{row['x']}"


def select_batch(universe: DataFrame, state: dict, batch_size: int, batch_count: int = 1, slots: int = 1) -> tuple[DataFrame, dict]:
    """The next rows of a ring over ``universe(place, ticker, cik)`` and the state that the next call goes on from.

    ``place`` numbers the supported rows from 0. Another universe than the state's starts again at 0."""
    if min(batch_size, batch_count, slots) < 1:
        raise ValueError("batch_size, batch_count and slots must be at least one")
    n = universe.count()
    if not n:
        raise ValueError("the universe has no supported rows")
    print_of = fingerprint(universe)
    start = int(state.get("next_offset") or 0) if state.get("fingerprint") in (None, print_of) else 0
    start, wanted = start % n, min(n, batch_size * batch_count)
    slot = F.pmod(F.col("place") - start, F.lit(n))
    chosen = universe.withColumn("slot", slot).where(F.col("slot") < wanted)
    return chosen, {"fingerprint": print_of, "size": n, "previous_offset": start, "next_offset": (start + wanted) % n, "planned_daily": min(n, batch_size * batch_count * slots)}


def numbered(universe: DataFrame, order: str = "cik") -> DataFrame:
    """``universe`` with ``place`` from 0 by ``order``, without one task that holds all of it."""
    return row_number(universe, order, "place")


def merge_in_order(existing: DataFrame, refreshed: DataFrame, key: str = "ticker", place: str = "place") -> DataFrame:
    """Refreshed rows replace existing ones at their place; new keys follow behind, in the order of the refresh."""
    e, r = existing.alias("e"), refreshed.withColumn("_new", F.lit(True)).alias("r")
    last = existing.agg(F.max(place)).first()[0]
    behind = F.lit(-1 if last is None else last) + 1 + F.col(f"r.{place}")
    cols = [F.coalesce(F.col(f"e.{place}"), behind).alias(c) if c == place else F.when(F.col("r._new"), F.col(f"r.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in existing.columns]
    return e.join(r, F.col(f"e.{key}") == F.col(f"r.{key}"), "full_outer").select(*cols)


def union_with_starter(starter: DataFrame, rows: DataFrame) -> DataFrame:
    """Starter rows first; of the others those whose key and ticker are both new, the first of each. Columns: key, ticker, place, ..."""
    both = rows.join(starter.select("key"), "key", "left_anti").join(starter.select("ticker"), "ticker", "left_anti").select(*rows.columns)
    first = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("place")) == 1
    both = both.withColumn("_k", first("key")).where("_k").withColumn("_t", first("ticker")).where("_t").drop("_k", "_t")
    return starter.withColumn("origin", F.lit(0)).unionByName(both.withColumn("origin", F.lit(1)))


def limit_two_classes(rows: DataFrame, limit: int, offset: int = 0, order: list[str] = ("priority", "ticker")) -> DataFrame:
    """``limit`` supported rows from ``offset`` on; only where these are fewer, unsupported ones fill up."""
    supported = rows.where("supported").orderBy(*order).offset(offset).limit(limit)
    left = max(0, limit - supported.count())
    return supported.unionByName(rows.where("not supported").orderBy(*order).limit(left))


def replace_errors(existing: DataFrame, errors: DataFrame, key: str = "ticker") -> DataFrame:
    """Errors of a batch instead of the older ones of the same tickers."""
    upper = lambda df: df.withColumn("_k", F.upper(key))
    kept = upper(existing).join(upper(errors).select("_k"), "_k", "left_anti").drop("_k")
    return kept.unionByName(errors)


def index_status(statuses: DataFrame, index: DataFrame, key: str = "ticker") -> DataFrame:
    """``statuses(ticker, data_status struct)`` with four flags set for tickers in the index, and the index's latest filing date."""
    known = index.select(F.upper(key).alias("_k"), "latest_filing_date", F.lit(True).alias("_in"))
    j = statuses.withColumn("_k", F.upper(key)).join(known, "_k", "left")
    flagged = F.coalesce("_in", F.lit(False))
    status = F.col("data_status")
    for f in ("filings_downloaded", "filings_cleaned", "filings_chunked", "bm25_indexed"):
        status = status.withField(f, flagged)
    return j.select(*[c for c in statuses.columns if c != "data_status"], status.alias("data_status"), "latest_filing_date")


def signal_status(status: Column, available: Column, confidence: Column, signal: Column, as_of: Column) -> Column:
    """A status struct with the fields that a score sets."""
    few = confidence == "Insufficient"
    return (status.withField("scoring_inputs_available", available >= 5).withField("scoring_available", ~few).withField("official_signal", signal)
            .withField("latest_scoring_date", as_of).withField("insufficient_reason", F.when(few, F.lit("Insufficient scoring inputs"))))


def status_label(scored: Column, searchable: Column, full: Column, partial: Column) -> Column:
    return F.concat_ws(" · ", F.when(scored, "Scored").otherwise("Insufficient"), F.when(searchable, "Searchable").otherwise("No BM25"), F.when(full, "Balance sheet full").when(partial, "Balance sheet partial").otherwise("No balance sheet"))


def parse_limit(value) -> int | None:
    """None, blank and "all" mean no limit; others must be positive."""
    text = "" if value is None else str(value).strip().lower()
    if text in ("", "all"):
        return None
    if int(text) <= 0:
        raise ValueError("limit must be positive or 'all'")
    return int(text)


def parse_offset(value) -> int:
    number = 0 if value is None else int(str(value).strip())
    if number < 0:
        raise ValueError("offset must be zero or greater")
    return number


def manifest_hash(entries: DataFrame) -> DataFrame:
    """One row: tickers, documents, terms and a hash of the entries' lines in order of ticker.

    ``entries(ticker, documents, terms, latest_filing_date, path)`` has a row for each ticker; the lines are hashed by ranges first, so that no row holds them all."""
    line = F.concat_ws(":", "ticker", F.col("documents").cast("string"), F.coalesce(F.col("latest_filing_date").cast("string"), F.lit("")), F.coalesce("path", F.lit("")))
    ranged = entries.withColumn("line", line).withColumn("prefix", F.substring("ticker", 1, 2))
    parts = ranged.groupBy("prefix").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("part"), F.count(F.lit(1)).alias("n"), F.sum("documents").alias("documents"), F.sum("terms").alias("terms"))
    return parts.agg(F.sum("n").alias("tickers"), F.sum("documents").alias("documents"), F.sum("terms").alias("terms"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "part"))), lambda p: p["part"]), "\n"), 256).alias("corpus_hash"))
