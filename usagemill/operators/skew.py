"""Joins and ordered look-backs that stay spread out when one key is hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_KEYS = 256
HOT_ROWS = 50_000


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", hot_rows: int = HOT_ROWS, total: int | None = None) -> DataFrame:
    """Join left to a right side that has one row per key, with any key skew.

    A key is hot if it carries more than 1/256 of left's rows (and at least
    hot_rows). There can be at most 255 such keys, so their right rows are
    broadcast: that is a bound by counting, whatever the data. All other rows
    take the shuffle join. Rows with a null key match nothing. Left should be a
    written table, as it is read once more for the counts; total is the number
    of its rows, if known.
    """
    total = left.count() if total is None else total
    hot = []
    if total > hot_rows:
        counts = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        hot = [r[0] for r in counts.filter(F.col("_n") > max(hot_rows, total // HOT_KEYS)).select(key).collect()]
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = left.filter(~is_hot).join(right.filter(~is_hot), key, how)
    warm = left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, how)
    return cold.unionByName(warm)


def lag_in_blocks(df: DataFrame, keys: list[str], order: str, block: Column, columns: list[str], prefix: str = "prev_") -> DataFrame:
    """The previous row's columns within keys by order, without one task per key.

    block must be a non-decreasing function of order. Rows look back inside
    (keys, block); the first row of a block takes the last row of the previous
    block that has any. The second window sees one row per (keys, block) only.
    """
    inner = Window.partitionBy(*keys, "_block").orderBy(order)
    packed = F.struct(*columns)
    rows = df.withColumn("_block", block).withColumn("_row", packed)
    rows = rows.withColumn("_prev", F.lag("_row").over(inner)).withColumn("_first", F.row_number().over(inner) == 1)
    tails = rows.groupBy(*keys, "_block").agg(F.max_by("_row", order).alias("_tail"))
    outer = Window.partitionBy(*keys).orderBy("_block")
    heads = tails.select(*keys, "_block", F.lag("_tail").over(outer).alias("_carried"))
    on = [*keys, "_block"]
    joined = rows.join(heads, on, "left")
    prev = F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_prev"))
    out = joined.withColumn("_prev", prev)
    for c in columns:
        out = out.withColumn(prefix + c, F.col("_prev").getField(c))
    return out.drop("_block", "_row", "_prev", "_first", "_carried")
