"""Readers: the stored tables, and the payload formats that price, fact and filing providers deliver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions.exprs import normalize_ticker

PRICE = "ticker string, date date, open double, high double, low double, close double, volume bigint, source string, adjusted_close double"
FACT = "concept string, label string, value double, unit string, period_end date, filed date, fiscal_year int, fiscal_period string, form string, accession string, source string"
CHART = "ticker string, timestamp array<bigint>, open array<double>, high array<double>, low array<double>, close array<double>, volume array<bigint>, adjclose array<double>"
COMPANY_FACTS = "cik string, facts map<string, map<string, struct<units: map<string, array<struct<val: double, `end`: string, filed: string, fy: int, fp: string, form: string, accn: string>>>>>>"
SUBMISSIONS = "cik string, form array<string>, filingDate array<string>, reportDate array<string>, accessionNumber array<string>, primaryDocument array<string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def price_csv(spark: SparkSession, path: str, keys: str = "") -> DataFrame:
    """Daily bars from CSV, also of many series: in folders ``ticker=``, or in common files whose first columns are ``keys`` (with types).

    Malformed lines are dropped. A source without a row is an error."""
    schema = f"{keys}, " * bool(keys) + "date date, open double, high double, low double, close double, volume bigint"
    rows = spark.read.csv(path, schema=schema, header=True, mode="DROPMALFORMED")
    if rows.isEmpty():
        raise ValueError(f"no price rows in {path}")
    return rows


def chart_bars(charts: DataFrame) -> DataFrame:
    """Bars from parallel arrays: a place with any null of time, prices or volume is skipped; the adjusted close may miss."""
    zipped = F.arrays_zip("timestamp", "open", "high", "low", "close", "volume", "adjclose")
    rows = charts.select("ticker", F.inline(zipped)).na.drop(subset=["timestamp", "open", "high", "low", "close", "volume"])
    return rows.select("ticker", F.to_date(F.timestamp_seconds("timestamp")).alias("date"), "open", "high", "low", "close", "volume", F.col("adjclose").alias("adjusted_close"))


def flatten_company_facts(payload: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Facts from nested maps: both namespaces merged (dei wins), concepts named by ``dictionary(concept, label, unit)``,
    annual and quarterly forms only, values that must be positive checked, rows with broken dates skipped."""
    rows = payload.select("cik", F.explode("facts").alias("space", "concepts")).where(F.col("space").isin("us-gaap", "dei"))
    rows = rows.select("cik", "space", F.explode("concepts").alias("concept", "body")).select("cik", "space", "concept", F.explode("body.units").alias("unit", "points"))
    # where both namespaces have a concept, dei's replaces the other
    last = rows.groupBy("cik", "concept").agg(F.min("space").alias("space"))
    rows = rows.join(last, ["cik", "concept", "space"], "left_semi").select("cik", "concept", "unit", F.inline("points"))
    named = rows.join(dictionary, ["concept", "unit"])  # some tens of rows: the size check before a broadcast is Spark's own
    out = named.select("cik", "concept", "label", F.col("val").alias("value"), "unit", F.expr("try_to_date(`end`, 'yyyy-MM-dd')").alias("period_end"), F.expr("try_to_date(filed, 'yyyy-MM-dd')").alias("filed"), F.col("fy").alias("fiscal_year"), F.col("fp").alias("fiscal_period"), "form", F.col("accn").alias("accession"))
    out = out.where(F.col("form").isin("10-K", "10-Q") & F.col("value").isNotNull() & F.col("period_end").isNotNull() & F.col("filed").isNotNull())
    return out.where(~(F.col("label").isin("Assets", "Shares outstanding") & (F.col("value") <= 0)))


def recent_filings(submissions: DataFrame, forms: list[str], per_form: int, since: str | None = None) -> DataFrame:
    """The latest ``per_form`` filings of each form and company, from parallel arrays."""
    from pyspark.sql import Window

    rows = submissions.select("cik", F.posexplode(F.arrays_zip("form", "filingDate", "reportDate", "accessionNumber", "primaryDocument")).alias("pos", "f")).select("cik", "pos", "f.*")
    rows = rows.where(F.upper("form").isin([f.upper() for f in forms]))
    if since:
        rows = rows.where(F.col("filingDate") >= since)
    nth = F.row_number().over(Window.partitionBy("cik", F.upper("form")).orderBy("pos"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= per_form).drop("pos", "nth")


def symbol_map(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Rows of arrays ``data`` with their field names as columns."""
    return rows.select(*[F.col("data")[i].alias(f) for i, f in enumerate(fields)])


def company_facts(spark: SparkSession, path: str) -> DataFrame:
    """One payload a company, as nested maps."""
    return spark.read.schema(COMPANY_FACTS).json(path)


def charts(spark: SparkSession, path: str) -> DataFrame:
    """Chart payloads: parallel arrays of each series."""
    return spark.read.schema(CHART).json(path)


def chart_lines(rows: DataFrame) -> DataFrame:
    """Payload lines of bars (ticker, day, open, high, low, close, volume, adj_close), the inverse of :func:`chart_bars`."""
    day = F.unix_seconds(F.col("day").cast("timestamp"))
    g = rows.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct(day.alias("timestamp"), "open", "high", "low", "close", "volume", F.col("adj_close").alias("adjclose")))).alias("a"))
    return g.select(F.to_json(F.struct(F.col("ticker").cast("string").alias("ticker"), *[F.col(f"a.{c}").alias(c) for c in ("timestamp", "open", "high", "low", "close", "volume", "adjclose")]), {"ignoreNullFields": "false"}).alias("value"))


def normalize_points(rows: DataFrame, order: list[str]) -> DataFrame:
    """(ticker, date, price) of raw points: blank dates and prices that aren't positive numbers go, of a date the last by ``order`` stays."""
    ok = rows.where(F.col("date").isNotNull() & (F.col("price") > 0) & (F.col("price") < float("inf")))
    return ok.groupBy("ticker", "date").agg(F.max_by("price", F.struct(*order)).alias("price"))


def reject_duplicate_dates(rows: DataFrame, order: list[str]) -> DataFrame:
    """(ticker, date, price, rejected): of a date the first by ``order`` stays; ``rejected`` counts the others."""
    return rows.groupBy("ticker", "date").agg(F.min_by("price", F.struct(*order)).alias("price"), (F.count(F.lit(1)) - 1).alias("rejected"))


def universe(rows: DataFrame, limit: int | None = None, offset: int = 0, tickers: list[str] | None = None) -> DataFrame:
    """Supported rows (missing means supported), by priority and ticker, one page of them."""
    out = rows.where(F.coalesce(F.col("isSupported"), F.lit(True))).withColumn("ticker", normalize_ticker("ticker"))
    if tickers is not None:
        out = out.where(F.col("ticker").isin([t.upper() for t in tickers]))
    out = out.orderBy("priority", "ticker")
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit is not None else out


def or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet rows, or none (with the schema) where nothing can be read."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def jdbc(spark: SparkSession, url: str, table_name: str, **options) -> DataFrame:
    return spark.read.format("jdbc").option("url", url).option("dbtable", table_name).options(**options).load()
