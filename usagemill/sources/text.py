"""Scans of line and document files, with provenance that keeps their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROW_BITS = 33


def lines(spark: SparkSession, path: str | list[str], any_of: list[str] | None = None, glob: str | None = None) -> DataFrame:
    """(src_file, modified_at, seq, raw) of all lines below path; .zst and .gz files are read as they are.

    seq rises along each file: the position of the scanned block, then the row
    in it. Files are split like any text, none is read as a whole. any_of are
    substrings of which a line must hold one: a cheap test ahead of parsing.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    seq = F.shiftleft(F.shiftright(F.col("_metadata.file_block_start"), 16), _ROW_BITS).bitwiseOR(row)
    df = reader.text(path).select(F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_modification_time").alias("modified_at"), seq.alias("seq"), F.col("value").alias("raw"))
    if any_of:
        keep = F.lit(False)
        for mark in any_of:
            keep = keep | F.col("raw").contains(mark)
        df = df.filter(keep)
    return df


def documents(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(src_file, modified_at, seq, raw) with one row per file; for formats that are one JSON value a file."""
    reader = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_modification_time").alias("modified_at"), F.lit(0).cast("bigint").alias("seq"), F.col("value").alias("raw"))


def parsed(df: DataFrame, schema: str, strict: bool = False) -> DataFrame:
    """df with j, the parsed raw; rows that don't parse are skipped. strict also skips repeated keys."""
    if strict:
        df = df.filter(F.try_parse_json("raw").isNotNull())
    whole = "_bad string, " + schema
    return df.withColumn("j", F.from_json("raw", whole, {"columnNameOfCorruptRecord": "_bad"})).filter(F.col("j").isNotNull() & F.col("j._bad").isNull())


def one_source_per_rollout(df: DataFrame) -> DataFrame:
    """Of files with the same relative path in several folders or encodings, the first."""
    relative = F.regexp_replace(F.regexp_extract("src_file", r"(?:archived_)?sessions/(.+)$", 1), r"\.zst$", "")
    name = F.when(relative == "", F.col("src_file")).otherwise(relative)
    first = df.groupBy(name.alias("_rel")).agg(F.min("src_file").alias("_src"))
    return df.join(first, (name == F.col("_rel")) & (F.col("src_file") == F.col("_src")), "left_semi")


def stem(path: str | Column = "src_file") -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[A-Za-z.]+)?$", 1)


def parent(path: str | Column, up: int = 1) -> Column:
    parts = F.split(path, "/")
    return F.try_element_at(parts, F.lit(-1 - up))


def recorded_ms(c: Column) -> Column:
    """Milliseconds of a time stamp written as text, seconds, milliseconds, microseconds or nanoseconds."""
    n = c.try_cast("double")
    scaled = F.when(n.isNull(), None).when(n < 1e11, n * 1000).when(n < 1e14, n).when(n < 1e17, n / 1000).otherwise(n / 1e6)
    return F.coalesce(scaled.cast("bigint"), F.unix_millis(c.try_cast("timestamp")))
