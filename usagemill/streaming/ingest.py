"""Structured Streaming: from growing folders of log files to tables.

The file source remembers what it has read in its checkpoint, so a restarted
job goes on where it stopped. Each micro-batch is written under its own number
and replaced as a whole if it is run again, which makes the sink idempotent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from usagemill.operators import delivery
from usagemill.operators.sessions import SessionTable, local_sessions


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Writes batch n to path/batch=n, over whatever a failed run has left there."""

    def write(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={n}")

    return write


def ingest(spark: SparkSession, source: str, schema: str, to: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, kind: str = "parquet", files_per_batch: int = 1000) -> StreamingQuery:
    """Takes all new files below source through transform into to, then stops."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").format(kind).load(source)
    return transform(stream).writeStream.foreachBatch(batch_sink(to)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(stream: DataFrame, ids: list[str], time: str, late: str) -> DataFrame:
    """Each message once, as long as its copies come within late of each other."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(ids)


def tumbling(stream: DataFrame, time: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums per window; a window is given out when the watermark has passed it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("value"))


def keep_sessions(table: SessionTable) -> Callable[[DataFrame, int], None]:
    """foreachBatch: merges a micro-batch of (keys, time_ms, gap_ms) rows into the stored sessions, once."""

    def merge(df: DataFrame, n: int) -> None:
        table.apply(local_sessions(df, table.keys, "time_ms", "gap_ms"), n)

    return merge


def accept_once(seen: delivery.SeenMessages, to: str, identity: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """foreachBatch: writes the rows whose message hasn't been seen, one of each.

    The rows are written first and counted as seen afterwards; a batch that dies
    in between writes the same rows over again. If only the count was left to
    do, the rows are covered, and what was written stays.
    """

    def write(df: DataFrame, n: int) -> None:
        fresh = seen.uncovered(identity(df))
        if fresh.limit(1).count():
            accepted = fresh.select(F.col("order_id").alias("record_id"))
            df.join(accepted, "record_id", "left_semi").write.mode("overwrite").parquet(f"{to}/batch={n}")
            seen.add(fresh)

    return write
