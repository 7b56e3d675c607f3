"""The canonical usage table every source is turned into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENS = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "extra_total_tokens")
USAGE = {
    "agent": "string", "session_id": "string", "project": "string", "message_id": "string", "request_id": "string", "ts_ms": "bigint", "date": "string",
    "model": "string", "provider": "string", "input_tokens": "bigint", "output_tokens": "bigint", "cache_creation_tokens": "bigint", "cache_1h_tokens": "bigint",
    "cache_read_tokens": "bigint", "extra_total_tokens": "bigint", "speed": "string", "cost_usd": "double", "credits": "double", "message_count": "bigint",
    "version": "string", "is_sidechain": "boolean", "src_file": "string", "seq": "bigint",
}
_ZERO = {*TOKENS}


def conform(df: DataFrame, agent: str | None = None, **columns: Column) -> DataFrame:
    """df as a usage table: named columns are taken, absent ones are null, counters 0.

    Provenance (src_file, seq) travels along, as all first-wins rules need it.
    """
    out = []
    for name, kind in USAGE.items():
        c = columns.get(name)
        if name == "agent" and c is None and agent is not None:
            c = F.lit(agent)
        c = F.lit(None) if c is None else c
        c = c.cast(kind)
        out.append((F.coalesce(c, F.lit(0).cast(kind)) if name in _ZERO else c).alias(name))
    return df.select(*out)


def total_tokens() -> Column:
    """All five counters, saturating at the largest long instead of failing."""
    return saturating_add(*[F.col(c) for c in TOKENS])


def saturating_add(first: Column, *rest: Column) -> Column:
    top = F.lit(9223372036854775807)
    for c in rest:
        first = F.coalesce(F.try_add(first, c), top)
    return first


def saturating_sum(c: str | Column) -> Column:
    """Sum of non-negative longs that stops at the largest long."""
    col = F.col(c) if isinstance(c, str) else c
    return F.least(F.sum(col.cast("decimal(38,0)")), F.lit(9223372036854775807).cast("decimal(38,0)")).cast("bigint")
