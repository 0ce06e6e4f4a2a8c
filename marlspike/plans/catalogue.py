"""All registered queries of the analytics operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import app_queries, backtest_queries, champion_queries, fact_queries, filing_queries, forecast_queries, index_queries, ingest_queries, price_queries, run_queries, screen_queries, search_queries, store_queries, stream_queries, user_queries  # noqa: F401  (they register)
from .registry import ORACLES, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
