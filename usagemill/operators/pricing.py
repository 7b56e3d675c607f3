"""Finding a model's price: exact, by alias, by normal form, by likeness, by time.

Names are resolved once per distinct model, and the few resolved rows are
joined to the usage. Price tables and the distinct models of a log are small,
but neither is taken on trust: they are broadcast up to MAX_NAMES rows and
joined by shuffle beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagemill.functions.names import aliased, normal_key
from usagemill.operators.cost import with_tiers
from usagemill.session import cut

MAX_NAMES = 100_000


def bounded(df: DataFrame, most: int = MAX_NAMES) -> DataFrame:
    """df, marked for broadcast if it has at most most rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def exact(models: DataFrame, price: DataFrame) -> DataFrame:
    """(model, key) for models that the price table names."""
    keys = price.select(F.col("model").alias("key")).distinct()
    return models.join(keys, models["model"] == keys["key"]).select("model", "key")


def by_alias(models: DataFrame, price: DataFrame, aliases: dict[str, str]) -> DataFrame:
    named = models.select("model", aliased(F.col("model"), aliases).alias("alias"))
    keys = price.select(F.col("model").alias("key")).distinct()
    return named.join(keys, named["alias"] == keys["key"]).select("model", "key")


def by_normal_form(models: DataFrame, price: DataFrame) -> DataFrame:
    """Separators are all alike; a form that several keys share gives nothing."""
    forms = price.groupBy(normal_key(F.col("model")).alias("form")).agg(F.min("model").alias("key"), F.count_distinct("model").alias("n")).filter(F.col("n") == 1)
    named = models.select("model", normal_key(F.col("model")).alias("form"))
    return named.join(forms, "form").select("model", "key")


def _boundary(text: Column, part: Column) -> Column:
    """Whether part stands somewhere in text between token boundaries, and no further version number follows it.

    A date of eight digits is no version. Both are in lower case.
    """
    literal = F.regexp_replace(part, r"([^a-z0-9])", r"\\$1")
    after = F.lit(r"(?:$|(?=[^a-z0-9])(?![-.][0-9])|(?=-[0-9]{8}(?:$|[^0-9])))")
    return F.rlike(text, F.concat(F.lit(r"(?:^|[^a-z0-9])"), literal, after))


def by_likeness(models: DataFrame, price: DataFrame) -> DataFrame:
    """The longest key that stands in the model name, or holds it; ties go to the least key.

    Of two such names one has all tokens of the other, so each name is looked
    for by its rarest token only among the other side's tokens: a common token,
    like a number, brings no pairs of its own.
    """
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda x: x != ""))
    m = models.select("model", F.explode(tokens(F.col("model"))).alias("token"))
    k = price.select(F.col("model").alias("key")).distinct().select("key", F.explode(tokens(F.col("key"))).alias("token"))

    def rarest(own: DataFrame, name: str, others: DataFrame) -> DataFrame:
        seen = others.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        return own.join(seen, "token", "left").groupBy(name).agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), F.col("token"))).alias("token"))

    pairs = rarest(k, "key", m).join(m, "token").select("model", "key").union(rarest(m, "model", k).join(k, "token").select("model", "key")).distinct()
    a, b = F.lower("model"), F.lower("key")
    fits = pairs.filter(_boundary(a, b) | _boundary(b, a))
    w = Window.partitionBy("model").orderBy(F.length("key").desc(), "key")
    return fits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("model", "key")


def resolve(models: DataFrame, price: DataFrame, aliases: dict[str, str] | None = None, exact_only: Column | None = None) -> DataFrame:
    """(model, key, how): the first lookup that finds something, in a fixed order.

    The distinct names are written first, so the rows they come from are read
    once, not once per lookup.
    """
    names = cut(models.select("model").filter(F.col("model").isNotNull()).distinct(), "models")
    like = names if exact_only is None else names.filter(~exact_only)
    steps = [("exact", exact(names, price)), ("alias", by_alias(names, price, aliases or {})), ("normal", by_normal_form(names, price)), ("like", by_likeness(like, price))]
    found = None
    for rank, (how, df) in enumerate(steps):
        part = df.select("model", "key", F.lit(how).alias("how"), F.lit(rank).alias("rank"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("model").agg(F.min_by(F.struct("key", "how"), "rank").alias("b"))
    return best.select("model", "b.key", "b.how")


def priced(usage: DataFrame, price: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """usage with the rates of its model, null where there is none."""
    price = with_tiers(price)
    found = resolve(usage, price, aliases)
    rates = cut(found.join(price.withColumnRenamed("model", "key"), "key").drop("key", "how").coalesce(1), "rates")
    return usage.join(bounded(rates), "model", "left")


def first_candidate(rows: DataFrame, row_id: str, candidates: str, price: DataFrame, rate: str, non_zero: bool = False) -> DataFrame:
    """(row_id, key, rate) of the first of several candidate names that has a price (above 0, if non_zero)."""
    each = rows.select(row_id, F.posexplode(candidates).alias("pos", "key"))
    keys = price.select(F.col("model").alias("key"), F.col(rate).alias("rate"))
    hits = each.join(bounded(keys), "key")
    hits = hits.filter(F.col("rate") > 0) if non_zero else hits
    return hits.groupBy(row_id).agg(F.min_by(F.struct("key", "rate"), "pos").alias("b")).select(row_id, "b.key", "b.rate")


def at_time(usage: DataFrame, schedule: DataFrame) -> DataFrame:
    """usage with the rate in force: schedule has (model, from_ms, to_ms, peak, rate).

    A row of the schedule with peak set holds in peak hours only (weekdays, 01-04
    and 06-10 UTC) and goes before one without.
    """
    ts = F.timestamp_millis(F.col("ts_ms"))
    weekday = F.dayofweek(ts).between(2, 6)
    hour = F.hour(ts)
    in_peak = weekday & ((hour.between(1, 3)) | hour.between(6, 9))
    # A model's entries as one array, so that a row of usage meets one row and stays one row.
    entry = F.struct(F.coalesce("peak", F.lit(False)).alias("peak"), F.coalesce("from_ms", F.lit(-(2**62))).alias("from_ms"), F.coalesce("to_ms", F.lit(2**62)).alias("to_ms"), "rate")
    listed = schedule.groupBy("model").agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
    joined = usage.withColumn("_peak", in_peak).join(bounded(listed), "model", "left")
    holds = F.filter("_entries", lambda e: (F.col("ts_ms") >= e["from_ms"]) & (F.col("ts_ms") < e["to_ms"]) & (~e["peak"] | F.col("_peak")))
    # Entries are in order of peak, then start: the last one that holds goes first.
    return joined.withColumn("rate", F.try_element_at(holds, F.lit(-1))["rate"]).select(*[F.col(f"`{c}`") for c in usage.columns], "rate")


def as_of(usage: DataFrame, releases: DataFrame, day: str = "date") -> DataFrame:
    """usage with the name of the latest release on or before its day: releases has (released_on, name).

    The days are few, so the as-of join is made on them and joined back.
    """
    days = usage.select(day).distinct()
    hit = days.join(bounded(releases), F.col("released_on") <= F.col(day), "left").groupBy(day).agg(F.max_by("name", "released_on").alias("release"))
    return usage.join(bounded(hit), day, "left")


def overridden(price: DataFrame, overrides: DataFrame) -> DataFrame:
    """price with given rates replaced; a new input rate scales the cache rates it leaves open."""
    o = overrides.select(F.col("model"), *[F.col(c).alias(f"o_{c}") for c in ("input_rate", "output_rate", "cache_create_rate", "cache_read_rate")])
    j = price.join(bounded(o), "model", "left")
    scale = F.when(F.col("o_input_rate").isNotNull() & (F.col("input_rate") > 0), F.col("o_input_rate") / F.col("input_rate")).otherwise(F.lit(1.0))
    out = {
        "input_rate": F.coalesce("o_input_rate", "input_rate"), "output_rate": F.coalesce("o_output_rate", "output_rate"),
        "cache_create_rate": F.coalesce(F.col("o_cache_create_rate"), F.col("cache_create_rate") * scale), "cache_read_rate": F.coalesce(F.col("o_cache_read_rate"), F.col("cache_read_rate") * scale),
    }
    return j.select(*[out.get(c, F.col(c)).alias(c) for c in price.columns])
