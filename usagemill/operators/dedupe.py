"""One row per usage event where logs repeat it.

Winners are found by aggregation (max_by over an order), which combines on the
map side: a key with very many copies is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagemill.functions.lenient import non_empty
from usagemill.schema import total_tokens


def keep_best(df: DataFrame, key: list[Column], better: list[Column]) -> DataFrame:
    """The row with the greatest order per key; better lists the criteria, first counts most.

    Rows whose key has a null stand for themselves.
    """
    keyed = df.withColumn("_k", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(key)]))
    whole = F.lit(True)
    for i in range(len(key)):
        whole = whole & F.col(f"_k.k{i}").isNotNull()
    columns = [F.col(f"`{c}`") for c in df.columns]
    best = keyed.filter(whole).groupBy("_k").agg(F.max_by(F.struct(*columns), F.struct(*better)).alias("_r")).select("_r.*")
    return best.unionByName(keyed.filter(~whole).select(*columns))


def keep_first(df: DataFrame, key: list[Column], order: str) -> DataFrame:
    return keep_best(df, key, [-F.col(order)])


def keep_last(df: DataFrame, key: list[Column], order: str) -> DataFrame:
    return keep_best(df, key, [F.col(order)])


def usage_key() -> list[Column]:
    """(message, request), or (message, session) without a request, and the time for ids of no known kind."""
    message, request, session = non_empty(F.col("message_id")), non_empty(F.col("request_id")), non_empty(F.col("session_id"))
    known = message.rlike("^(msg|resp)_")
    rest = F.when(request.isNotNull(), F.concat(F.lit("r:"), request)).when(known, F.concat(F.lit("s:"), session)).otherwise(F.concat_ws(":", F.lit("t"), F.coalesce(session, F.lit("")), F.col("ts_ms").cast("string")))
    return [message, rest]


def best_usage(usage: DataFrame) -> DataFrame:
    """Of equal messages: main thread before side chain, more tokens, higher cost, a known speed, then the first."""
    better = [~F.coalesce(F.col("is_sidechain"), F.lit(False)), total_tokens(), F.coalesce(F.col("cost_usd"), F.lit(0.0)), F.col("speed").isNotNull(), -F.col("seq")]
    return keep_best(usage, usage_key(), better)


def without_replays(usage: DataFrame) -> DataFrame:
    """best_usage, and side-chain copies of a message in the same session dropped.

    A side-chain row goes if a main-thread row of the same message and session
    has the same time, or if neither has a request.
    """
    kept = best_usage(usage)
    side = F.coalesce(F.col("is_sidechain"), F.lit(False)) & non_empty(F.col("message_id")).isNotNull()
    main = kept.filter(~side).select(F.col("message_id").alias("_m"), F.col("session_id").alias("_s"), F.col("ts_ms").alias("_t"), non_empty(F.col("request_id")).alias("_r"))
    c = kept.filter(side)
    same = (c["message_id"] == main["_m"]) & (c["session_id"] == main["_s"]) & ((c["ts_ms"] == main["_t"]) | (non_empty(c["request_id"]).isNull() & main["_r"].isNull()))
    return kept.filter(~side).unionByName(c.join(main, same, "left_anti"))


def across_files(df: DataFrame, key: list[str], source: str, order: str) -> DataFrame:
    """Copies of events in other files go, repeats within one file stay.

    The n-th occurrence of an event in any file is one event; its first file
    wins.
    """
    from usagemill.operators.ordered import occurrence

    numbered = occurrence(df, source, key, [order])
    shown = [F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in key]
    return keep_first(numbered, [*shown, F.col("occurrence")], order)


def content_key(*columns: str) -> Column:
    """A key of several fields joined by the unit separator; null and empty differ."""
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns])


def with_priority(parts: list[DataFrame], key: list[Column], order: str) -> DataFrame:
    """The union of parts, one row per key: earlier parts go first, then the order."""
    union = None
    for i, p in enumerate(parts):
        p = p.withColumn("_p", F.lit(i))
        union = p if union is None else union.unionByName(p)
    return keep_best(union, key, [-F.col("_p"), -F.col(order)]).drop("_p")
