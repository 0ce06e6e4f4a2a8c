"""Ranks over whole columns in which no task holds a column.

Values are split at approximate quantiles of their group; within a split a
window ranks them, and the counts of the splits before are added. The quantiles
only balance the splits: the ranks are exact whatever they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspike.functions.exprs import rounded
from marlspike.sources.scratch import written

#: Splits of a group; ``CUTS - 1`` values of each group reach the driver.
CUTS = 64


def _split(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """``rows`` with ``_split`` (null for a null value) and ``_before``: how many values of the group stand in lower splits, and ``_n`` of them in all."""
    spark, number = rows.sparkSession, F.col(value).cast("double")
    shares = F.array(*[F.lit(k / CUTS) for k in range(1, CUTS)])
    cuts = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_distinct(F.percentile_approx(number, shares, 1000)).alias("_cuts"))
    cuts = F.broadcast(spark.createDataFrame(cuts.collect(), cuts.schema))  # a row for each group: features, not entities
    one = lambda a, b, on: a.join(b, on, "left") if on else a.crossJoin(b)  # without keys the other side is one row
    split = F.when(F.col(value).isNotNull(), F.size(F.filter("_cuts", lambda c: c < number)))
    rows = one(rows, cuts, keys).withColumn("_split", split).drop("_cuts")
    held = rows.where("_split is not null").groupBy(*keys, "_split").agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*keys)
    held = held.withColumn("_before", F.coalesce(F.sum("_c").over(order.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_c").over(order))
    return rows.join(F.broadcast(held.drop("_c")), [*keys, "_split"], "left")  # at most CUTS rows a group


def average_rank(rows: DataFrame, value: str, keys: list[str], out: str, digits: int = 6) -> DataFrame:
    """Adds ``out``: (below + (equal - 1) / 2) / (n - 1) among the non-null values of the group; one value alone is 0.5, null stays null."""
    split = _split(rows, value, keys)
    by = Window.partitionBy(*keys, "_split")
    below = F.col("_before") + F.rank().over(by.orderBy(value)) - 1
    equal = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_split", value))
    pct = F.when(F.col(value).isNotNull(), F.when(F.col("_n") == 1, F.lit(0.5)).otherwise((below + (equal - 1) / 2) / (F.col("_n") - 1)))
    return split.withColumn(out, rounded(pct, digits)).select(*rows.columns, out)


def row_number(rows: DataFrame, order: str, out: str) -> DataFrame:
    """Adds ``out``: the row's place from 0 by ``order``, a column of different numbers."""
    split = _split(rows, order, [])
    return split.withColumn(out, F.col("_before") + F.row_number().over(Window.partitionBy("_split").orderBy(order)) - 1).select(*rows.columns, out)


def neighbours(rows: DataFrame, group: str, order: str) -> DataFrame:
    """(order, previous, next): each row's neighbours in its group by ``order``, a column of different values.

    Rows are sorted by ranges of (group, order), so no task holds a group; the ends of a range look to the nearest range with their group."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.select(group, order).repartitionByRange(n, F.col(group).asc_nulls_first(), F.col(order)).withColumn("_p", F.spark_partition_id()), "ranged")
    own = Window.partitionBy("_p", group).orderBy(order)
    inside = ranged.withColumn("_before", F.lag(order).over(own)).withColumn("_after", F.lead(order).over(own))
    ends = ranged.groupBy("_p", group).agg(F.min(order).alias("_low"), F.max(order).alias("_high"))
    over = Window.partitionBy(group).orderBy("_p")  # a row for each range
    ends = ends.select(F.col("_p").alias("_q"), F.col(group).alias("_g"), F.lag("_high").over(over).alias("_last"), F.lead("_low").over(over).alias("_first"))
    joined = inside.join(ends, (F.col("_p") == F.col("_q")) & F.col(group).eqNullSafe(F.col("_g")), "left")
    return joined.select(order, F.coalesce("_before", "_last").alias("previous"), F.coalesce("_after", "_first").alias("next"))


def slot_of(place: str | Column, start: int, size: int) -> Column:
    """Place in a ring of ``size`` that begins at ``start``."""
    return F.pmod((F.col(place) if isinstance(place, str) else place) - start, F.lit(size))
