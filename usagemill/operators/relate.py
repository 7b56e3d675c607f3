"""Joins between sources: what another source has counted, and shared identities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagemill.session import cut


def union_all(parts: dict[str, DataFrame], label: str = "agent") -> DataFrame:
    """All sources under one another, each with its label."""
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn(label, F.lit(name)) for name, df in parts.items()])


def not_counted(rows: DataFrame, counted: DataFrame, on: list[str]) -> DataFrame:
    """rows that counted doesn't cover on the given columns. A null covers nothing, so rows with one need no join."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    known = counted.filter(whole).select(*on).distinct()
    return rows.filter(whole).join(known, on, "left_anti").select(rows.columns).unionByName(rows.filter(~whole))


def precedence(tiers: list[DataFrame], ids: list[str]) -> DataFrame:
    """Rows of each tier that no earlier tier has under any of the ids."""
    out, seen = None, {i: None for i in ids}
    for tier in tiers:
        fresh = tier
        for i in ids:
            if seen[i] is not None:
                # Rows without the id, however many, stay where they are.
                fresh = fresh.filter(F.col(i).isNotNull()).join(seen[i], i, "left_anti").select(tier.columns).unionByName(fresh.filter(F.col(i).isNull()))
        for i in ids:
            mine = tier.filter(F.col(i).isNotNull()).select(i).distinct()
            seen[i] = mine if seen[i] is None else seen[i].union(mine)
        out = fresh if out is None else out.unionByName(fresh)
    return out


def after_cutoff(rows: DataFrame, cutoffs: DataFrame, on: list[str], time: str, cutoff: str) -> DataFrame:
    """rows later than their key's cut-off, or without one."""
    joined = rows.join(cutoffs, on, "left")
    return joined.filter(F.col(cutoff).isNull() | (F.col(time) > F.col(cutoff))).drop(cutoff)


def best_attribute(rows: DataFrame, key: str, value: str, priority: str, order: str) -> DataFrame:
    """Per key the value of highest priority, the first of ties."""
    return rows.filter(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, F.struct(F.col(priority), -F.col(order))).alias(value))


def replayed_prefix(child: DataFrame, parent: DataFrame, pair: str, order: str, content: str) -> DataFrame:
    """child rows with replayed: whether they repeat the parent's rows from the start, position by position.

    child and parent have (pair, order, content), pair naming the fork.
    """
    w = Window.partitionBy(pair).orderBy(order)
    c, p = child.withColumn("pos", F.row_number().over(w)), parent.select(pair, F.row_number().over(w).alias("pos"), F.col(content).alias("_parent"))
    same = F.coalesce(F.col(content) == F.col("_parent"), F.lit(False)).cast("int")
    upto = Window.partitionBy(pair).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return c.join(p, [pair, "pos"], "left").withColumn("replayed", F.min(same).over(upto) == 1).drop("_parent")


def copied_history(rows: DataFrame, forks: DataFrame, session: str | list[str], seq: str) -> DataFrame:
    """rows of forked sessions beyond the point they were copied up to; forks has (session, cutoff)."""
    joined = rows.join(forks, session, "left")
    return joined.filter(F.col("cutoff").isNull() | (F.col(seq) > F.col("cutoff"))).drop("cutoff")


def shared_identities(pairs: DataFrame, row: str, identity: str) -> DataFrame:
    """(row, component): rows that share an identity, directly or through others, have one component.

    Labels spread by least-label steps over both columns, with shortcuts through
    the labels themselves; each step is two aggregations with map-side combining.
    """
    state = cut(pairs.select(F.col(row).alias("row"), F.col(identity).alias("ident")).filter("ident is not null").distinct().withColumn("label", F.col("row")), "labels")
    while True:
        low = state.groupBy("ident").agg(F.min("label").alias("low"))
        spread = state.join(low, "ident").groupBy("row").agg(F.min("low").alias("low"))
        jump = spread.select(F.col("row").alias("low"), F.col("low").alias("lower"))
        short = spread.join(jump, "low", "left").select("row", F.coalesce("lower", "low").alias("fresh"))
        stepped = cut(state.join(short, "row").select("row", "ident", F.least("label", "fresh").alias("label"), (F.col("fresh") < F.col("label")).alias("moved")), "labels")
        done = stepped.filter("moved").limit(1).count() == 0
        state = stepped.drop("moved")
        if done:
            return state.groupBy(F.col("row").alias(row)).agg(F.min("label").alias("component"))
