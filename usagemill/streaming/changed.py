"""What has changed since the last run: files by size and time, tables by fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "src_file string, modified_at timestamp, size bigint"


def listing(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(src_file, modified_at, size) of the files below path; their contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.col("path").alias("src_file"), F.col("modificationTime").alias("modified_at"), F.col("length").alias("size"))


def stale(now: DataFrame, known: DataFrame) -> DataFrame:
    """Files that are new, or have another size or time than when they were known."""
    return now.join(known, ["src_file", "modified_at", "size"], "left_anti")


def gone(now: DataFrame, known: DataFrame) -> DataFrame:
    return known.join(now.select("src_file"), "src_file", "left_anti")


def refreshed(parsed: DataFrame, fresh: DataFrame, now: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of parsed whose file is as it was, and the fresh rows of the others."""
    kept = parsed.join(now.join(known, ["src_file", "modified_at", "size"]).select("src_file"), "src_file", "left_semi")
    return kept.unionByName(fresh.select(kept.columns))


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, hash): the same for the same rows in any order, repeats counted."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("hash"))
