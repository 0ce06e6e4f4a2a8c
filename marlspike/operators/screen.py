"""The sortable screen: filters, seven sort keys in both directions, and pages that are never past the last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of the confidence levels, rows of a page.
CONFIDENCE = {"High": 4, "Medium": 3, "Low": 2, "Insufficient": 1}
PAGE = 50
KEYS = ("ticker", "value", "quality", "momentum", "confidence", "price", "trend")


def sort_key(name: str) -> Column:
    """What a key sorts by: a missing score is below all others."""
    if name not in KEYS:
        raise ValueError(f"unknown sort key: {name}")
    if name == "confidence":
        ranks = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
        return F.try_element_at(ranks, F.col(name))
    return F.col(name) if name in ("ticker", "price") else F.coalesce(F.col(name), F.lit(-1.0))


def matching(rows: DataFrame, query: str = "", **equal: str) -> DataFrame:
    """Rows whose ticker, name or sector holds ``query``, and whose columns equal those named, but for "all"."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("ticker", "name", "sector")]))
    wanted = query.strip().lower()
    out = rows.where(text.contains(wanted)) if wanted else rows
    for column, value in equal.items():
        if value != "all":
            out = out.where(F.col(column) == value)
    return out


def page(rows: DataFrame, sort: str = "ticker", descending: bool = False, number: int = 1, size: int = PAGE) -> tuple[DataFrame, int, int]:
    """(rows of the page with ``place``, its number, number of pages); a number beyond the last page means the last one.

    Ties are in order of ticker. Only the rows up to the page's end are sorted out of each partition."""
    pages = max(1, -(-rows.count() // size))
    number = min(max(1, number), pages)
    key = sort_key(sort)
    order = [key.desc_nulls_last() if descending else key.asc_nulls_first(), F.col("ticker")]
    found = rows.orderBy(*order).offset((number - 1) * size).limit(size)
    return found.withColumn("place", F.row_number().over(Window.orderBy(*order)) + (number - 1) * size), number, pages  # a page of rows
