"""Batch checkpoints as a data source: a file for each batch, opened only if a filter can find something in it.

A run lands its batches under one folder: ``batch-N.jsonl`` with one record a
line (ticker, status, error, payload as JSON text), and beside it ``batch-N.index``
with the batch's status and tickers. The source plans one partition for each
batch file; filters on ``ticker`` and ``batch`` are pushed down and leave only
the batches that name the ticker, so a lookup opens one file. Index files are
read a listing at a time on the driver (a line for each ticker of a batch, and
nothing of the payloads); records stream through the tasks.

The folder must be one that driver and executors open alike; Spark's own readers
serve others (:func:`landed`).
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "batch int, ticker string, status string, error string, payload string"


class Batch(InputPartition):
    def __init__(self, number: int, path: str, tickers: list[str] | None):
        self.number, self.path, self.tickers = number, path, tickers


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else path


class CheckpointReader(DataSourceReader):
    """Plans a partition for each batch that may hold a wanted row."""

    def __init__(self, folder: str, partial: bool):
        self.folder, self.partial = _local(folder), partial
        self.tickers: set[str] | None = None
        self.numbers: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("ticker",):
                self.tickers = values if self.tickers is None else self.tickers & values
            elif values is not None and f.attribute == ("batch",):
                self.numbers = values if self.numbers is None else self.numbers & values
            else:
                yield f  # Spark applies it

    def partitions(self) -> list[Batch]:
        out = []
        for name in sorted(os.listdir(self.folder)):
            if not (name.startswith("batch-") and name.endswith(".index")):
                continue
            number = int(name[6:-6])
            if self.numbers is not None and number not in self.numbers:
                continue
            with open(f"{self.folder}/{name}", encoding="utf-8") as f:
                index = json.load(f)
            if index["status"] != "complete" and not self.partial:
                continue
            wanted = None if self.tickers is None else sorted(self.tickers & set(index["tickers"]))
            if wanted is None or wanted:
                out.append(Batch(number, f"{self.folder}/{name[:-6]}.jsonl", wanted))
        return out

    def read(self, part: Batch | None) -> Iterator[tuple]:
        if part is None:  # no batch can match
            return
        wanted = None if part.tickers is None else set(part.tickers)
        with open(part.path, encoding="utf-8") as f:
            for line in f:
                r = json.loads(line)
                if wanted is None or r["ticker"] in wanted:
                    yield part.number, r["ticker"], r["status"], r.get("error"), r.get("payload")


class CheckpointSource(DataSource):
    """``spark.read.format("checkpoints").load(folder)``; option ``partial`` also reads batches that aren't complete."""

    @classmethod
    def name(cls) -> str:
        return "checkpoints"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CheckpointReader:
        return CheckpointReader(self.options["path"], str(self.options.get("partial", "false")).lower() == "true")


def scan(spark: SparkSession, folder: str, partial: bool = False) -> DataFrame:
    """Lazy rows of the checkpoints under ``folder``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CheckpointSource)
    return spark.read.format("checkpoints").option("partial", str(partial).lower()).load(folder)


def write(rows: DataFrame, folder: str, batch: str = "batch") -> None:
    """Land ``rows(batch, ticker, status, error, payload)``: a file for each batch, whole before its index, which says whether all its rows succeeded or failed for good.

    A batch is one task's, since its file is one; batches are of bounded size."""
    os.makedirs(_local(folder), exist_ok=True)
    place = _local(folder)

    def put(key, rows):
        number = int(key[0])
        path, index = f"{place}/batch-{number}.jsonl", f"{place}/batch-{number}.index"
        records = rows.sort_values("ticker", kind="stable")[["ticker", "status", "error", "payload"]].astype(object).where(rows.notna(), None).to_dict("records")
        for name, lines in ((path, records), (index, [{"status": "partial" if any(r["status"] == "pending" for r in records) else "complete", "tickers": [r["ticker"] for r in records]}])):
            with open(f"{name}.part-{os.getpid()}", "w", encoding="utf-8") as f:
                f.writelines(json.dumps(r) + "\n" for r in lines)
            os.replace(f.name, name)
        return rows[[batch]].head(1).assign(n=len(records))[["n"]].astype("int64")

    rows.select(batch, "ticker", "status", "error", "payload").groupBy(batch).applyInPandas(put, "n long").agg(F.sum("n")).first()


class Provider:
    """Where a ticker's records come from: ``rows(tickers)`` gives (ticker, status, error, payload). One kind reads checkpoints, one a table."""

    def rows(self, tickers: list[str] | None = None) -> DataFrame:
        raise NotImplementedError


class CheckpointProvider(Provider):
    def __init__(self, spark: SparkSession, folder: str, partial: bool = False):
        self.spark, self.folder, self.partial = spark, folder, partial

    def rows(self, tickers: list[str] | None = None) -> DataFrame:
        found = scan(self.spark, self.folder, self.partial)
        return (found if tickers is None else found.where(F.col("ticker").isin(tickers))).drop("batch")


class FixtureProvider(Provider):
    """A table of records at hand."""

    def __init__(self, table: DataFrame):
        self.table = table

    def rows(self, tickers: list[str] | None = None) -> DataFrame:
        found = self.table.select("ticker", "status", "error", "payload")
        return found if tickers is None else found.where(F.col("ticker").isin(tickers))


def landed(make, path: str, spark: SparkSession, key: str, complete: Column, force: bool = False) -> tuple[DataFrame, bool]:
    """The table at ``path`` if it was landed for the same ``key`` and all its rows are ``complete``, else what ``make()`` gives, landed; and whether it was reused."""
    from .scratch import file_system

    fs, place = file_system(spark, f"{path}/key={key}/_SUCCESS")
    if not force and fs.exists(place):
        held = spark.read.parquet(f"{path}/key={key}")
        if held.limit(1).count() and not held.where(~F.coalesce(complete, F.lit(False))).limit(1).count():
            return held, True
    make().write.mode("overwrite").parquet(f"{path}/key={key}")
    return spark.read.parquet(f"{path}/key={key}"), False
