"""Price tables from feeds: one JSON object by model, or a catalogue by provider.

Feeds are small documents, one per file. The result has one row per model: the
four rates per token, those above a context size, the size, speed factors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagemill.sources.text import documents

#: Field names of a feed, the long and the short spelling.
FIELDS = {
    "input_rate": ("input_cost_per_token", "i"), "output_rate": ("output_cost_per_token", "o"), "cache_create_rate": ("cache_creation_input_token_cost", "cc"), "cache_read_rate": ("cache_read_input_token_cost", "cr"),
    "input_above": ("input_cost_per_token_above_200k_tokens", "ia"), "output_above": ("output_cost_per_token_above_200k_tokens", "oa"), "cache_create_above": ("cache_creation_input_token_cost_above_200k_tokens", "cca"), "cache_read_above": ("cache_read_input_token_cost_above_200k_tokens", "cra"),
    "context_limit": ("max_input_tokens", "ctx"), "fast_factor": ("provider_specific_entry.fast", "fast"), "flex_factor": ("provider_specific_entry.flex", "flex"),
}


def feed(spark: SparkSession, path: str) -> DataFrame:
    """A feed {model: {rates}}; models without an input rate are left out, of repeated ones the first file counts."""
    rows = documents(spark, path).select("src_file", F.explode(F.from_json("raw", "map<string, string>")).alias("model", "body"))
    pick = lambda names: F.coalesce(*[F.get_json_object("body", f"$.{n}") for n in names]).try_cast("double")
    rates = rows.select("src_file", "model", *[pick(names).alias(k) for k, names in FIELDS.items()]).filter("input_rate is not null")
    kept = [k for k in FIELDS]
    return rates.groupBy("model").agg(F.min_by(F.struct(*kept), "src_file").alias("r")).select("model", "r.*").withColumn("context_limit", F.col("context_limit").cast("bigint"))


def catalogue(spark: SparkSession, path: str, trust: list[str] | None = None) -> DataFrame:
    """A catalogue {provider: {models: {key: {cost per million}}}}.

    Where providers share a model, the one that comes first in trust counts,
    then the fuller entry, then the lesser provider name.
    """
    cost = "cost struct<input double, output double, cache_read double, cache_write double>, `limit` struct<context bigint>"
    rows = documents(spark, path).select(F.explode(F.from_json("raw", f"map<string, struct<models map<string, struct<id string, {cost}>>>>")).alias("provider", "p"))
    rows = rows.select("provider", F.explode("p.models").alias("key", "m")).filter("m.cost.input is not null")
    order = {name: i for i, name in enumerate(trust or [])}
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("provider")), F.lit(len(order))) if order else F.lit(0)
    fuller = F.col("m.cost.cache_read").isNotNull().cast("int") + F.col("m.cost.cache_write").isNotNull().cast("int") + F.col("m.limit.context").isNotNull().cast("int")
    million = lambda c: (F.col(f"m.cost.{c}") / 1e6)
    out = F.struct(million("input").alias("input_rate"), million("output").alias("output_rate"), million("cache_write").alias("cache_create_rate"), million("cache_read").alias("cache_read_rate"), F.col("m.limit.context").alias("context_limit"), F.lit(None).cast("double").alias("fast_factor"))
    best = rows.groupBy(F.coalesce("m.id", "key").alias("model")).agg(F.min_by(out, F.struct(rank, -fuller, "provider", "key")).alias("r"))
    return best.select("model", "r.*")
