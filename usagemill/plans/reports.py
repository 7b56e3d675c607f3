"""The report commands, as plans over a usage table and a price table.

A report is a lazy DataFrame; nothing is collected. Options are a frozen record,
and now is one of them, so a report gives the same rows whenever it is run.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagemill.functions.dates import in_dates, last_periods, normal_bound, report_date
from usagemill.operators import aggregate, blocks, cost, ordered, pricing
from usagemill.schema import TOKENS, total_tokens
from usagemill.session import cut


@dataclass(frozen=True)
class ReportOptions:
    since: str | None = None
    until: str | None = None
    last: int | None = None
    today: str | None = None
    project: str | None = None
    mode: str = "auto"
    order: str = "asc"
    zone: str = "UTC"
    week_start: str = "sunday"
    block_hours: float = 5.0
    now_ms: int = 0
    active: bool = False
    recent: bool = False
    token_limit: int | str | None = None
    aliases: dict[str, str] = field(default_factory=dict)
    by_project: bool = False
    with_cost: bool = True
    policies: dict[str, cost.CostPolicy] = field(default_factory=dict)
    tier_tokens: int = cost.TIER_TOKENS
    project_sessions: tuple[str, ...] = ("claude",)

    def __post_init__(self) -> None:
        if self.last is not None and (self.since or self.until):
            raise ValueError("last doesn't go with since or until")
        for bound in (self.since, self.until):
            if bound:
                normal_bound(bound)
        if self.mode not in ("auto", "display", "calculate") or self.order not in ("asc", "desc"):
            raise ValueError("unknown mode or order")

    def window(self, unit: str) -> ReportOptions:
        """last, as a first day for reports by unit."""
        if self.last is None:
            return self
        from datetime import date

        if not self.today:
            raise ValueError("last needs today")
        return replace(self, last=None, since=last_periods(date.fromisoformat(self.today), unit, self.last, self.week_start))


def priced(usage: DataFrame, price: DataFrame, o: ReportOptions) -> DataFrame:
    """usage with cost, stored_cost and missing_price, dated in the report's zone, of the asked project.

    A table that is priced already is only dated and filtered.
    """
    u = usage.withColumn("date", report_date(F.col("ts_ms"), o.zone))
    if o.project:
        u = u.filter(F.col("project") == o.project)
    if "missing_price" in usage.columns:
        return u
    logged = F.col("cost_usd")
    if o.mode == "display" and all(p.display != "tokens" for p in o.policies.values()):
        shown = cost.by_policy(o.policies, lambda p: p.cost("display", logged, F.lit(0.0)))
        return u.withColumn("cost", shown).withColumn("stored_cost", F.lit(0.0)).withColumn("missing_price", F.lit(False))
    p = pricing.priced(u, price, o.aliases)
    billed = cost.by_policy(o.policies, lambda x: F.lit(x.extra_billed))
    tokens, own = cost.computed(extra_billed=billed, tier_tokens=o.tier_tokens), cost.by_policy(o.policies, lambda x: x.uses_logged(o.mode, logged))
    lacks = (total_tokens() > 0) & F.col("model").isNotNull() & F.col("input_rate").isNull() & ~own
    amount = cost.by_policy(o.policies, lambda x: x.cost(o.mode, logged, tokens))
    stored = F.when(own, F.coalesce(logged, F.lit(0.0))).otherwise(F.lit(0.0)) if o.mode == "auto" else F.lit(0.0)
    return p.withColumns({"cost": amount, "stored_cost": stored, "missing_price": lacks}).select(*u.columns, "cost", "stored_cost", "missing_price")


def _shape(df: DataFrame, o: ReportOptions) -> DataFrame:
    return df if o.with_cost else without_cost(df.drop("cost_per_minute", "projected_cost"))


def _sorted(df: DataFrame, o: ReportOptions, *keys: str) -> DataFrame:
    return df.orderBy(*[F.col(k).desc() if o.order == "desc" else F.col(k).asc() for k in keys])


def periods(usage: DataFrame, price: DataFrame, unit: str, options: ReportOptions | None = None) -> DataFrame:
    """Usage by day, week or month, with models and their breakdowns; by project too, if asked."""
    o = (options or ReportOptions()).window(unit)
    rows = priced(usage, price, o).filter(in_dates(F.col("date"), o.since, o.until))
    rows = rows.withColumn("period", aggregate.period(F.col("date"), unit, o.week_start)).withColumn("project", F.coalesce("project", F.lit("unknown")))
    keys = ["period", "project"] if o.by_project else ["period"]
    return _sorted(_shape(aggregate.nested_breakdown(rows, keys), o), o, *keys)


def sessions(usage: DataFrame, price: DataFrame, options: ReportOptions | None = None) -> DataFrame:
    """Sessions by cost, dearest first; sessions without tokens are left out."""
    o = (options or ReportOptions()).window("day")
    rows = priced(usage, price, o).filter(in_dates(F.col("date"), o.since, o.until))
    # Agents that keep sessions per project give a session for each; of others a session is one wherever it ran.
    rows = rows.withColumn("session_project", F.when(F.col("agent").isin(*o.project_sessions), F.col("project")))
    found = aggregate.sessions(rows, ["agent", "session_project", "session_id"]).filter(F.col("total_tokens") > 0)
    return _shape(found.orderBy(F.desc("total_cost"), "agent", "session_project", "session_id"), o)


def session(usage: DataFrame, price: DataFrame, session_id: str, options: ReportOptions | None = None) -> DataFrame:
    """The rows of one session, named by its own id or by the end of its file's path."""
    o = options or ReportOptions()
    mine = (F.col("session_id") == session_id) | F.col("src_file").contains(f"/{session_id}.")
    return _shape(priced(usage, price, o).filter(mine), o).orderBy("ts_ms", "seq")


def billing_blocks(usage: DataFrame, price: DataFrame, options: ReportOptions | None = None) -> DataFrame:
    """Blocks with burn rate, projection and limit status.

    Blocks are built from the whole history; dates, recent and active choose
    among them afterwards, and the limit max is the largest finished block of
    those chosen.
    """
    o = options or ReportOptions()
    length = int(o.block_hours * blocks.HOUR)
    rows = priced(usage, price, o).withColumn("tokens", total_tokens())
    found = blocks.blocks(rows, ["agent"], length, ["tokens", "cost"])
    found = found.filter(in_dates(report_date(F.col("block_ms"), o.zone), o.since, o.until))
    found = found.withColumn("active", blocks.is_active(o.now_ms, length))
    if o.recent:
        found = found.filter(blocks.is_recent(o.now_ms, length=length))
    if o.active:
        found = found.filter("active")
    rated = blocks.projection(blocks.burn_rate(found, "tokens", "cost"), "tokens", "cost", o.now_ms)
    if o.token_limit == "max":
        top = found.agg(F.max(F.when(~F.col("active"), F.col("tokens"))).alias("token_limit"))
        rated = rated.withColumn("token_limit", top.scalar())
    else:
        rated = rated.withColumn("token_limit", F.lit(o.token_limit).cast("bigint"))
    rated = rated.withColumn("limit_status", F.when(F.col("token_limit").isNotNull(), blocks.limit_status(F.coalesce("projected_tokens", "tokens"), F.col("token_limit"))))
    return _sorted(_shape(rated, o), o, "block_ms")


def unified(usage: DataFrame, price: DataFrame, unit: str = "day", options: ReportOptions | None = None) -> DataFrame:
    """All agents: period, agent and model rows under one another (level 1, 2, 3) and the grand total (0)."""
    o = (options or ReportOptions(week_start="monday")).window(unit)
    rows = priced(usage, price, o).filter(in_dates(F.col("date"), o.since, o.until) & (total_tokens() > 0))
    return _sorted(_shape(aggregate.unified(rows, unit, o.week_start), o), o, "period", "level", "agent", "model")


def statusline(usage: DataFrame, price: DataFrame, session_id: str, options: ReportOptions, context_limit: int = 200_000) -> DataFrame:
    """One row: cost of the session, of today and of the active block, and the context in use."""
    o = options
    rows = priced(usage, price, o)
    day = report_date(F.lit(o.now_ms), o.zone)
    costs = rows.agg(
        F.sum(F.when(F.col("session_id") == session_id, F.col("cost"))).alias("session_cost"), F.sum(F.when(F.col("date") == day, F.col("cost"))).alias("today_cost")
    )
    length = int(o.block_hours * blocks.HOUR)
    found = blocks.blocks(rows, [], length, ["cost"]).filter(blocks.is_active(o.now_ms, length))
    block = blocks.burn_rate(found.withColumn("tokens", F.lit(0)), "tokens", "cost").agg(F.max("cost").alias("block_cost"), F.max("cost_per_minute").alias("cost_per_minute"), F.max("end_ms").alias("block_end_ms"))
    here = rows.filter(F.col("session_id") == session_id).withColumn("context", F.col("input_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens"))
    last = ordered.last_of(here, ["session_id"], ["ts_ms", "seq"], ["context", "model"]).agg(F.max("context").alias("context_tokens"), F.max("model").alias("model"))
    parts = [(df, df.select(F.struct(*df.columns)).scalar()) for df in (costs, block, last)]
    row = usage.sparkSession.range(1).select(*[value.alias(f"_{i}") for i, (_, value) in enumerate(parts)])
    flat = row.select(*[F.col(f"_{i}.{c}").alias(c) for i, (df, _) in enumerate(parts) for c in df.columns])
    return flat.withColumn("context_share", F.col("context_tokens") / context_limit)


def totals(report: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """Grand totals of a report's rows; with the priced usage, also the models that had no price."""
    out = aggregate.totals(report)
    if usage is None:
        return out
    lacking = usage.filter("missing_price").agg(F.array_sort(F.collect_set("model")).alias("unpriced_models"))
    return out.join(lacking)


def envelope(report: DataFrame, name: str, usage: DataFrame | None = None) -> DataFrame:
    """One JSON document: {name: [rows], totals: {...}}. Its size is that of a report, not of the usage."""
    row = F.struct(*[F.col(c) for c in report.columns])
    rows = report.withColumn("_n", F.monotonically_increasing_id()).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", row.alias("r")))), lambda x: x["r"]).alias("rows"))
    grand = totals(report, usage)
    both = rows.join(grand.select(F.struct(*grand.columns).alias("totals")))
    return both.select(F.to_json(F.struct(F.col("rows").alias(name), "totals")).alias("json"))


def as_json(report: DataFrame) -> DataFrame:
    """One JSON text per report row."""
    return report.select(F.to_json(F.struct(*[F.col(c) for c in report.columns])).alias("json"))


def by_project_json(report: DataFrame) -> DataFrame:
    """One row per project, its report rows as a JSON array in order of period."""
    row = F.struct(*[F.col(c) for c in report.columns])
    listed = report.groupBy(F.coalesce("project", F.lit("unknown")).alias("project_name")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return listed.select(F.col("project_name").alias("project"), F.to_json("rows").alias("json"))


def without_cost(df: DataFrame) -> DataFrame:
    """Drops cost columns, also inside model breakdowns."""
    names = {"total_cost", "cost", "cost_usd", "stored_cost"}
    out = df.drop(*names)
    if "model_breakdowns" in out.columns:
        inner: list[str] = [f.name for f in out.schema["model_breakdowns"].dataType.elementType.fields if f.name not in names]
        out = out.withColumn("model_breakdowns", F.transform("model_breakdowns", lambda s: F.struct(*[s[n].alias(n) for n in inner])))
    return out


def select_sql(report: DataFrame, sql: str) -> DataFrame:
    """Any SQL over the view named report: the place for users' own projections."""
    return report.sparkSession.sql(sql, report=report) if "{report}" in sql else _through_view(report, sql)


def _through_view(report: DataFrame, sql: str) -> DataFrame:
    report.createOrReplaceTempView("report")
    return report.sparkSession.sql(sql)


def sections(usage: DataFrame, price: DataFrame, units: list[str], options: ReportOptions | None = None) -> dict[str, DataFrame]:
    """Several reports of one usage table, in the order asked for; the table is read and priced once."""
    o = options or ReportOptions()
    usage = cut(priced(usage, price, o), "priced")
    return {u: sessions(usage, price, options) if u == "session" else periods(usage, price, u, options) for u in units}


def money(c: Column) -> Column:
    return F.round(c, 2)


__all__ = ["TOKENS", "ReportOptions", "as_json", "billing_blocks", "by_project_json", "envelope", "money", "periods", "priced", "sections", "select_sql", "session", "sessions", "statusline", "totals", "unified", "without_cost"]
