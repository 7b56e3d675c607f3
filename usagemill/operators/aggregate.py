"""Roll-ups of usage: by any key, by model inside a key, over sessions, over periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagemill.functions.dates import month_of, week_start
from usagemill.schema import TOKENS, saturating_sum, total_tokens


def sums(cost: str = "cost") -> list[Column]:
    """Sums of all counters and cost. Credits and message counts stay null where no row has any."""
    return [
        *[saturating_sum(c).alias(c) for c in TOKENS], saturating_sum(total_tokens()).alias("total_tokens"), F.sum(cost).alias("total_cost"),
        F.sum("credits").alias("credits"), F.sum("message_count").alias("message_count"), F.count(F.lit(1)).alias("entries"),
    ]


def flags(usage: DataFrame) -> list[Column]:
    """Whether any row lacks a price, and what part of the cost was logged, where rows tell."""
    out = [F.bool_or("missing_price").alias("missing_price")] if "missing_price" in usage.columns else []
    return [*out, F.sum("stored_cost").alias("stored_cost")] if "stored_cost" in usage.columns else out


def by_key(usage: DataFrame, keys: list[str], cost: str = "cost") -> DataFrame:
    return usage.groupBy(*keys).agg(*sums(cost), *flags(usage))


def breakdown(usage: DataFrame, keys: list[str], cost: str = "cost") -> DataFrame:
    """One row per key and model. Rows without a model count in their key's totals only."""
    return usage.filter(F.col("model").isNotNull()).groupBy(*keys, "model").agg(*sums(cost), *flags(usage), F.min("seq").alias("first_seq"))


def nested_breakdown(usage: DataFrame, keys: list[str], cost: str = "cost") -> DataFrame:
    """by_key with models_used (in the order first seen) and model_breakdowns (dearest first, ties as first seen)."""
    per_model = breakdown(usage, keys, cost)
    fields = ["model", *TOKENS, "total_tokens", "total_cost", *[c for c in ("missing_price",) if c in usage.columns]]
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("total_cost")).alias("_o"), F.col("first_seq"), *fields)))
    lists = per_model.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first_seq", "model"))), lambda s: s["model"]).alias("models_used"),
        F.transform(ordered, lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias("model_breakdowns"),
    )
    return by_key(usage, keys, cost).join(lists, keys, "left")


def sessions(usage: DataFrame, keys: list[str], cost: str = "cost") -> DataFrame:
    """Per session: totals, first and last activity, the latest row's project (first of ties), versions."""
    latest = F.max_by(F.struct("project", "src_file"), F.struct(F.col("ts_ms"), -F.col("seq")))
    return usage.groupBy(*keys).agg(
        *sums(cost), *flags(usage), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), latest["project"].alias("latest_project"),
        F.array_join(F.array_sort(F.collect_set("version")), ",").alias("versions"),
    )


def period(day: Column, unit: str, start: str = "monday") -> Column:
    if unit == "day":
        return day
    if unit == "month":
        return month_of(day)
    if unit == "week":
        return week_start(day, start)
    raise ValueError(f"unknown unit {unit}")


def rebucket(daily: DataFrame, unit: str, start: str = "monday") -> DataFrame:
    """Daily rows as weeks or months."""
    keep = [*TOKENS, "total_tokens", "total_cost", "credits", "message_count", "entries"]
    aggs = [F.sum(c).alias(c) if c in ("total_cost", "credits", "message_count", "entries") else saturating_sum(c).alias(c) for c in keep]
    return daily.groupBy(period(F.col("date"), unit, start).alias("period")).agg(*aggs)


def unified(usage: DataFrame, unit: str = "day", start: str = "monday", cost: str = "cost") -> DataFrame:
    """Period, agent and model as a rollup; level is 0 for the grand total up to 3 for a model's row."""
    keyed = usage.withColumn("period", period(F.col("date"), unit, start))
    rolled = keyed.rollup("period", "agent", "model").agg(*sums(cost), F.grouping_id().alias("_g"))
    return rolled.withColumn("level", F.when(F.col("_g") == 7, 0).when(F.col("_g") == 3, 1).when(F.col("_g") == 1, 2).otherwise(3)).drop("_g")


def totals(report: DataFrame) -> DataFrame:
    """Grand totals over report rows, after their filters."""
    found = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*TOKENS, "total_tokens")]
    credits = [F.sum("credits").alias("credits")] if "credits" in report.columns else []
    return report.agg(*found, F.coalesce(F.sum("total_cost"), F.lit(0.0)).alias("total_cost"), *credits)


def unpriced(usage: DataFrame, missing: str) -> DataFrame:
    """Models that some row could not be priced for."""
    return usage.filter(F.col(missing)).select("model").distinct()
