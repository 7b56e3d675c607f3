"""Usage rows from the nested tables of delivered records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagemill.functions.dates import report_date
from usagemill.functions.names import display_model
from usagemill.operators.sessions import instant_ms
from usagemill.schema import conform


def first_agent(df: DataFrame, zone: str = "UTC") -> DataFrame:
    """claude_usage in canonical columns; rows without a usable instant are left out."""
    u = df.withColumn("_ms", instant_ms(F.col("timestamp"))).filter(F.col("_ms").isNotNull())
    usage = "message.usage"
    return conform(
        u, "claude", session_id=F.col("sessionId"), project=F.col("project"), message_id=F.col("message.id"), request_id=F.col("requestId"), ts_ms=F.col("_ms"),
        date=report_date(F.col("_ms"), zone), model=display_model(F.col("message.model")), input_tokens=F.col(f"{usage}.input_tokens"), output_tokens=F.col(f"{usage}.output_tokens"),
        cache_creation_tokens=F.col(f"{usage}.cache_creation_input_tokens"), cache_read_tokens=F.col(f"{usage}.cache_read_input_tokens"), speed=F.col(f"{usage}.speed"),
        cost_usd=F.col("costUSD"), version=F.col("version"), is_sidechain=F.col("isSidechain"), src_file=F.col("src_file"), seq=F.col("record_id"),
    )


def second_agent(df: DataFrame, zone: str = "UTC") -> DataFrame:
    """codex_records in canonical columns: cached input is part of the input and taken out of it."""
    u = df.withColumn("_ms", instant_ms(F.col("timestamp"))).filter(F.col("_ms").isNotNull())
    usage = "payload.usage"
    cached = F.least(F.coalesce(F.col(f"{usage}.cached_input_tokens"), F.lit(0)), F.coalesce(F.col(f"{usage}.input_tokens"), F.lit(0)))
    return conform(
        u, "codex", session_id=F.regexp_extract("src_file", r"([^/]+)\.jsonl$", 1), message_id=F.col("payload.response_id"), ts_ms=F.col("_ms"), date=report_date(F.col("_ms"), zone),
        model=F.col("payload.model"), input_tokens=F.col(f"{usage}.input_tokens") - cached, output_tokens=F.col(f"{usage}.output_tokens"), cache_read_tokens=cached,
        src_file=F.col("src_file"), seq=F.col("record_id"),
    )
