"""A ledger that keeps usage after its source is gone.

Rows are inserted once under (namespace, dedup_key) and their cost stays as it
was when they were written. Reports take live rows, and ledger rows whose key
is no longer live. Each append is a folder of its own, published by a manifest,
so that readers see whole appends only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagemill.operators.dedupe import content_key, keep_first
from usagemill.session import delete_path

SYNTHETIC = ("session_id", "ts_ms", "model", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "extra_total_tokens", "cost_usd")


def with_key(usage: DataFrame) -> DataFrame:
    """usage with dedup_key: its message id, else a key of its content."""
    own = F.nullif(F.trim("message_id"), F.lit(""))
    return usage.withColumn("dedup_key", F.coalesce(F.concat(F.lit("m:"), own), F.concat(F.lit("c:"), content_key(*SYNTHETIC))))


class Ledger:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _fs(self, name: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def parts(self, namespace: str) -> list[str]:
        p, fs = self._fs(f"{self.path}/{namespace}/_published")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, namespace: str) -> DataFrame | None:
        paths = [f"{self.path}/{namespace}/{n}" for n in self.parts(namespace)]
        return self.spark.read.parquet(*paths) if paths else None

    def append(self, namespace: str, usage: DataFrame) -> None:
        """Insert rows whose key the ledger doesn't have; the first of equal keys wins."""
        rows = keep_first(with_key(usage), [F.col("dedup_key")], "seq")
        stored = self.read(namespace)
        fresh = rows if stored is None else rows.join(stored.select("dedup_key"), "dedup_key", "left_anti").select(rows.columns)
        name = f"{len(self.parts(namespace)):08d}"
        fresh.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{namespace}/{name}")
        p, fs = self._fs(f"{self.path}/{namespace}/_published/{name}")
        fs.create(p, False).close()

    def merged(self, namespace: str, live: DataFrame, live_only: bool = False) -> DataFrame:
        """Live rows, and stored rows that are live no more."""
        keyed = with_key(live)
        stored = None if live_only else self.read(namespace)
        if stored is None:
            return keyed
        gone = stored.join(keyed.select("dedup_key").distinct(), "dedup_key", "left_anti")
        return keyed.unionByName(gone.select(keyed.columns))

    def clear(self, namespace: str | None = None) -> None:
        delete_path(self.spark, f"{self.path}/{namespace}" if namespace else self.path)
