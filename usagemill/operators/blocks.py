"""Billing blocks of fixed length, the gaps between them, burn rates and limits.

A block starts at the full hour of its first event and takes events up to
length after its start; the next event beyond, or one more than length after
the last, opens the next block.

Events are first reduced to cells on the grid of the greatest common divisor of
length and the hour. Block ends fall on that grid, so a cell is never divided,
and the fold over a key's cells meets a number of rows that is bounded by the
time they span. Cells are right-closed, as an event exactly at a block's end
still belongs to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000
DEFAULT_MS = 5 * HOUR


def cells(events: DataFrame, keys: list[str], length: int, measures: list[str], time: str = "ts_ms") -> DataFrame:
    """(keys, cell, first_ms, last_ms, entries, measures) on the grid that blocks of length end on."""
    grid = math.gcd(int(length), HOUR)
    cell = F.ceil(F.col(time) / grid).cast("bigint")
    return events.filter(F.col(time).isNotNull()).groupBy(*keys, cell.alias("cell")).agg(
        F.min(time).alias("first_ms"), F.max(time).alias("last_ms"), F.count(F.lit(1)).alias("entries"), *[F.sum(m).alias(m) for m in measures]
    )


def _fold(length: int, n_keys: int):  # noqa: ANN202
    """Adds block_no and block_ms to rows sorted by key and cell; keeps one key's last block in hand, no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, start, last, number = None, 0, 0, 0
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(n_keys)]
            firsts, lasts = b.column(n_keys + 1).to_pylist(), b.column(n_keys + 2).to_pylist()
            numbers, starts = [], []
            for *k, first, end in zip(*columns, firsts, lasts):
                if k != key:
                    key, start, number = k, first // HOUR * HOUR, 0
                elif first - start > length or first - last > length:
                    start, number = first // HOUR * HOUR, number + 1
                last = end
                numbers.append(number)
                starts.append(start)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers, pa.int64()), pa.array(starts, pa.int64())], names=[*b.schema.names, "block_no", "block_ms"])

    return run


def blocks(events: DataFrame, keys: list[str], length: int = DEFAULT_MS, measures: list[str] | None = None, time: str = "ts_ms") -> DataFrame:
    """One row per block: (keys, block_ms, first_ms, last_ms, end_ms, entries, measures).

    With a length below an hour, an event further than length into its hour is
    beyond the end of the block it opens, so it is a block of its own, and the
    events before that point of an hour are one block: no fold is needed.
    """
    if length <= 0:
        raise ValueError("a block needs a length above 0")
    taken = measures or []
    if length < HOUR:
        return _short_blocks(events, keys, length, taken, time)
    parts = cells(events, keys, length, taken, time)
    schema = ", ".join([*(f"`{n}` {t}" for n, t in parts.dtypes), "block_no bigint", "block_ms bigint"])
    placed = parts.repartition(*keys) if keys else parts.repartition(1)
    marked = placed.sortWithinPartitions(*keys, "cell").mapInArrow(_fold(length, len(keys)), schema)
    out = marked.groupBy(*keys, "block_no", "block_ms").agg(
        F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.sum("entries").alias("entries"), *[F.sum(m).alias(m) for m in taken]
    )
    return out.drop("block_no").withColumn("end_ms", F.col("block_ms") + length)


def _short_blocks(events: DataFrame, keys: list[str], length: int, measures: list[str], time: str) -> DataFrame:
    hour = F.floor(F.col(time) / HOUR).cast("bigint") * HOUR
    rows = events.filter(F.col(time).isNotNull()).withColumn("block_ms", hour)
    early = F.col(time) - F.col("block_ms") <= length
    together = rows.filter(early).groupBy(*keys, "block_ms").agg(
        F.min(time).alias("first_ms"), F.max(time).alias("last_ms"), F.count(F.lit(1)).alias("entries"), *[F.sum(m).alias(m) for m in measures]
    )
    alone = rows.filter(~early).select(*keys, "block_ms", F.col(time).alias("first_ms"), F.col(time).alias("last_ms"), F.lit(1).cast("bigint").alias("entries"), *measures)
    return together.unionByName(alone).withColumn("end_ms", F.col("block_ms") + length)


def gaps(found: DataFrame, keys: list[str], length: int = DEFAULT_MS) -> DataFrame:
    """The idle stretches: from length after a block's last event to the next block's first."""
    w = Window.partitionBy(*keys).orderBy("first_ms")
    rows = found.withColumn("_last", F.lag("last_ms").over(w)).filter(F.col("first_ms") - F.col("_last") > length)
    return rows.select(*keys, (F.col("_last") + length).alias("gap_start_ms"), F.col("first_ms").alias("gap_end_ms"))


def is_active(now_ms: int, length: int = DEFAULT_MS) -> Column:
    return (F.lit(now_ms) - F.col("last_ms") < length) & (F.lit(now_ms) < F.col("end_ms"))


def is_recent(now_ms: int, days: int = 3, length: int = DEFAULT_MS) -> Column:
    return (F.col("block_ms") >= now_ms - days * 24 * HOUR) | is_active(now_ms, length)


def burn_rate(found: DataFrame, tokens: str, cost: str) -> DataFrame:
    """Tokens and cost per minute between a block's first and last event, null for an instant."""
    minutes = (F.col("last_ms") - F.col("first_ms")) / 60_000
    per = lambda c: F.when(minutes > 0, F.col(c) / minutes)
    return found.withColumn("tokens_per_minute", per(tokens)).withColumn("cost_per_minute", per(cost))


def projection(rated: DataFrame, tokens: str, cost: str, now_ms: int) -> DataFrame:
    """What a block comes to at its end at its present rate; cost to the cent."""
    left = F.greatest((F.col("end_ms") - F.lit(now_ms)) / 60_000, F.lit(0.0))
    projected = F.col(tokens) + F.col("tokens_per_minute") * left
    return rated.withColumn("projected_tokens", F.round(projected).cast("bigint")).withColumn("projected_cost", F.round(F.col(cost) + F.col("cost_per_minute") * left, 2))


def limit_status(tokens: Column, limit: Column | int) -> Column:
    """ok, warning above 80 %, exceeds above the limit."""
    top = F.lit(limit) if isinstance(limit, int) else limit
    return F.when(tokens > top, "exceeds").when(tokens > top * 0.8, "warning").otherwise("ok")


def largest_finished(found: DataFrame, tokens: str, now_ms: int, length: int = DEFAULT_MS) -> DataFrame:
    """The most tokens of any block that isn't active."""
    return found.agg(F.max(F.when(~is_active(now_ms, length), F.col(tokens))).alias("max_tokens"))


def anchor(events: DataFrame, keys: list[str], length: int = DEFAULT_MS, time: str = "ts_ms") -> DataFrame:
    """Where the latest stretch of activity began: the last event after a pause above length, else the first."""
    parts = cells(events, keys, length, [], time)
    w = Window.partitionBy(*keys).orderBy("cell")
    opens = F.col("first_ms") - F.lag("last_ms").over(w) > length
    rows = parts.withColumn("_opens", opens)
    return rows.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("_opens"), F.col("first_ms"))), F.min("first_ms")).alias("anchor_ms"))
