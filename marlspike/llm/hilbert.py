"""Sharding along a Hilbert curve (operator 5).

Several metadata dimensions are quantised to equal-depth cells, the cells'
Hilbert index gives each document a place on one curve, and the sorted rows are
cut into runs. A run covers a compact box of the dimensions, so a filter on any
of them prunes shards. Runs hold equally many rows (counts at most one apart).

Cells end at quantiles of the rows. Numbers' quantiles come from a mergeable
summary (exact to one in ``ACCURACY`` rows); other values, strings among them,
are counted by whole value and summed up in order, so values with a long common
prefix, and one value far from all others, are told apart like any.

Equal texts take one place on the curve, the first of their own places, and
stand together there: a cut alone can part them.

Defined cases: a null in a dimension takes cell 0, as does the smallest value;
ties on the curve are ordered by the text's crc32 and hash, then by doc_id;
null and empty texts are equal texts; a text of any length is one row; repeated
rows take a slot each; an empty table gives an empty result. Only the named
columns are read, so extra columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import many_to_one, materialize, prefix_sum, range_sorted

ACCURACY = 10_000


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of integer cells (rows, dimensions), by Skilling's transposed form."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            flip = (x[i] >> b) & 1 == 1
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ np.where(flip, low, swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t ^= np.where((x[n - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ t) >> b) & 1)
    return out


def borders(df: DataFrame, dims: list[str], bits: int) -> dict[str, list]:
    """The smallest value of each cell of each dimension but the first cell; fewer where values repeat a lot.

    ``df`` is a written table. 2^bits values a dimension reach the driver.
    """
    cells, kinds = 1 << bits, dict(df.dtypes)
    numbers = [c for c in dims if kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double", "date")]
    shares = F.array(*[F.lit(k / cells) for k in range(1, cells)])
    least = df.agg(*[F.min(c).alias(c) for c in dims], *[F.percentile_approx(c, shares, ACCURACY).alias(f"_q{c}") for c in numbers]).first()
    out = {c: least[f"_q{c}"] or [] for c in numbers}
    for c in [c for c in dims if c not in numbers]:
        values = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("c"))
        summed = prefix_sum(range_sorted(values, [F.col("v")], "values"), [], ["v"], F.col("c"), "upto")
        n = summed.agg(F.sum("c")).first()[0] or 0
        middle = F.expr(f"least((2 * upto - c) * {cells} div {2 * max(n, 1)}, {cells - 1})")  # the cell of a value's middle row
        out[c] = [r["v"] for r in summed.groupBy(middle.alias("cell")).agg(F.min("v").alias("v")).collect()]
    return {c: sorted({v for v in out[c] if v != least[c]}) for c in dims}


def curve(df: DataFrame, dims: list[str], bits: int = 4) -> DataFrame:
    """``df`` (a written table) with column ``curve``: the Hilbert index of the ``dims``."""
    found = borders(df, dims, bits)
    kinds = dict(df.dtypes)
    cells = []
    for c in dims:
        passed = [(F.col(c) >= F.lit(v).cast(kinds[c])).cast("int") for v in found[c]]
        cells.append(F.coalesce(sum(passed[1:], passed[0]) if passed else F.lit(0), F.lit(0)))

    @F.pandas_udf("long")
    def index(*cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([x.to_numpy() for x in cells], 1), bits))

    return df.withColumn("curve", index(*cells))


def shard(docs: DataFrame, dims: list[str], n_shards: int = 16, bits: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, curve, shard and slot (gapless from 0 in each shard) of every document."""
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    names = [f"_d{i}" for i in range(len(dims))]
    base = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("_h"),
                       *[F.col(c).alias(n) for c, n in zip(dims, names)])
    placed = materialize(curve(materialize(base, "dims"), names, bits).drop(*names), "places")
    # equal texts (by size, crc32 and hash) move to the first of their places
    same = F.struct("size", "text_crc32", "_h")
    groups = placed.groupBy("size", "text_crc32", "_h").agg(F.min("curve").alias("_first"), F.max("curve").alias("_last"), F.count(F.lit(1)).alias("_c")).where("_first < _last")
    groups = materialize(groups.select(same.alias("_text"), "_first", "_c"), "groups")
    keyed = placed.withColumn("_text", same)
    moved = many_to_one(keyed, groups, "_text", "_c").withColumn("curve", F.col("_first")).select(*placed.columns)
    if not groups.limit(1).count():
        rows = placed
    else:
        rows = moved.unionByName(keyed.join(groups.select("_text"), "_text", "left_anti").select(*placed.columns))
    order = ["curve", "text_crc32", "_h", F.col("doc_id").asc_nulls_first(), "size"]
    ranged = range_sorted(rows, order, "curve")
    total = ranged.count()
    rank = prefix_sum(ranged, [], order, F.lit(1).cast("long"), "_rank").withColumn("_at", F.col("_rank") - 1)
    cut = F.expr(f"(_at * {n_shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {n_shards - 1}) div {n_shards}")
    return rank.withColumn("shard", cut.cast("int")).withColumn("slot", (F.col("_at") - first).cast("long")).select("doc_id", "size", "text_crc32", "curve", "shard", "slot")
