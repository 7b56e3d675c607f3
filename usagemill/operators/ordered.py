"""Operators that look along an order: deltas, carried values, ordinals, bursts.

Keys are sources of one log (a file, a session), whose length is bounded by how
one process writes; order is (order columns), which must be unique per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _upto(keys: list[str], order: list[str]):  # noqa: ANN202
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def cumulative_to_delta(df: DataFrame, keys: list[str], order: list[str], counters: list[str]) -> DataFrame:
    """Each counter's rise since the row before, at least 0, as delta_*; a fall counts as 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    for c in counters:
        df = df.withColumn(f"delta_{c}", F.greatest(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0)), F.lit(0)))
    return df


def last_or_delta(df: DataFrame, keys: list[str], order: list[str], total: str, last: str) -> DataFrame:
    """The row's own last value where the running total advanced, else the total's rise; 0 for a repeated total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rise = F.greatest(F.col(total) - F.coalesce(F.lag(total).over(w), F.lit(0)), F.lit(0))
    return df.withColumn("usage", F.when(rise == 0, F.lit(0)).otherwise(F.coalesce(F.col(last), rise)))


def carry_forward(df: DataFrame, keys: list[str], order: list[str], column: str, to: str) -> DataFrame:
    """The last non-null value up to the row."""
    return df.withColumn(to, F.last(column, ignorenulls=True).over(_upto(keys, order)))


def carry_known(df: DataFrame, keys: list[str], order: list[str], present: Column, value: Column, to: str) -> DataFrame:
    """Like carry_forward, but a value that is present and unknown (null) resets what is carried."""
    boxed = F.when(present, F.struct(value.alias("v")))
    return df.withColumn(to, F.last(boxed, ignorenulls=True).over(_upto(keys, order))["v"])


def occurrence(df: DataFrame, source: str, key: list[str], order: list[str], to: str = "occurrence") -> DataFrame:
    """Ordinal of equal rows within a source: tells true repeats from copies in another source."""
    return df.withColumn(to, F.row_number().over(Window.partitionBy(source, *key).orderBy(*order)))


def suffix_min(df: DataFrame, keys: list[str], order: list[str], column: str, to: str) -> DataFrame:
    """The least value from the row to the end."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return df.withColumn(to, F.min(column).over(w))


def lasting_rise(df: DataFrame, keys: list[str], order: list[str], column: str, to: str) -> DataFrame:
    """The rise of the running maximum that later rows don't take back."""
    raised = suffix_min(df.withColumn("_top", F.max(column).over(_upto(keys, order))), keys, order, column, "_floor")
    held = F.least("_top", "_floor")
    w = Window.partitionBy(*keys).orderBy(*order)
    lasting = raised.withColumn("_held", F.max(held).over(_upto(keys, order)))
    return lasting.withColumn(to, F.col("_held") - F.coalesce(F.lag("_held").over(w), F.lit(0))).drop("_top", "_floor", "_held")


def leading_burst(df: DataFrame, keys: list[str], order: list[str], time: str, start: str, pause: int = 1_000, to: str = "in_burst") -> DataFrame:
    """Rows at the head of a log that follow each other within pause, if the first comes within pause of start."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.coalesce(F.lag(time).over(w), F.col(start))
    broken = (F.col(time) - before > pause).cast("int")
    return df.withColumn("_broken", broken).withColumn(to, F.max("_broken").over(_upto(keys, order)) == 0).drop("_broken")


def last_of(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last row's columns per key, by aggregation instead of a sort."""
    picked = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*keys).agg(picked.alias("_l")).select(*keys, *[F.col(f"_l.{c}").alias(c) for c in columns])


def top(df: DataFrame, by: list[Column], n: int) -> DataFrame:
    """The first n rows in a total order, without sorting all of them globally."""
    return df.orderBy(*by).limit(n)
