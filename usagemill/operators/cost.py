"""Cost of usage from per-token rates, as column expressions.

Rates come as columns of a price table that was joined on; nothing here knows a
price. Cost is taken per row, as tiers depend on each request's size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagemill.schema import saturating_add

RATES = ("input_rate", "output_rate", "cache_create_rate", "cache_read_rate")
HOUR_FACTOR = 2.0
CREATE_FACTOR, READ_FACTOR = 1.25, 0.1


def cache_created(flat: Column, five_minutes: Column, one_hour: Column) -> Column:
    """The split by lifetime counts where it is there, else the flat number."""
    split = F.coalesce(five_minutes, F.lit(0)) + F.coalesce(one_hour, F.lit(0))
    return F.when(five_minutes.isNotNull() | one_hour.isNotNull(), split).otherwise(F.coalesce(flat, F.lit(0)))


def default_rates(input_rate: Column, create: Column, read: Column) -> tuple[Column, Column]:
    """Cache rates, derived from the input rate where none is given."""
    return F.coalesce(create, input_rate * CREATE_FACTOR), F.coalesce(read, input_rate * READ_FACTOR)


def marginal(tokens: Column, base: Column, above: Column, threshold: Column | int) -> Column:
    """Tokens beyond the threshold at the higher rate, if there is one."""
    limit = F.lit(threshold) if isinstance(threshold, int) else threshold
    tiered = F.least(tokens, limit) * base + F.greatest(tokens - limit, F.lit(0)) * above
    return F.when(above.isNotNull() & (tokens > limit), tiered).otherwise(tokens * base)


def whole_request(tokens: Column, base: Column, above: Column, context: Column, threshold: Column) -> Column:
    """The whole request at the higher rate once its context is above the threshold."""
    return tokens * F.when((context > threshold) & above.isNotNull(), above).otherwise(base)


def one_hour(tokens: Column, input_rate: Column) -> Column:
    """Cache writes that live for an hour."""
    return tokens * input_rate * HOUR_FACTOR


def by_mode(mode: str, logged: Column, computed: Column) -> Column:
    """display: what was logged or 0; auto: logged, else computed; calculate: computed."""
    if mode == "display":
        return F.coalesce(logged, F.lit(0.0))
    if mode == "auto":
        return F.coalesce(logged, computed)
    if mode == "calculate":
        return computed
    raise ValueError(f"unknown cost mode {mode}")


def speed_factor(speed: Column, fast: Column) -> Column:
    return F.when(speed == "fast", F.coalesce(fast, F.lit(1.0))).otherwise(F.lit(1.0))


ABOVE = ("input_above_rate", "output_above_rate", "cache_create_above_rate", "cache_read_above_rate")
TIER_TOKENS = 200_000


def with_tiers(price: DataFrame) -> DataFrame:
    """price with all columns that a cost can depend on; those it lacks are null."""
    for c in (*ABOVE, "fast_factor"):
        if c not in price.columns:
            price = price.withColumn(c, F.lit(None).cast("double"))
    return price if "context_threshold" in price.columns else price.withColumn("context_threshold", F.lit(None).cast("bigint"))


def computed(fast: bool = True, extra_billed: Column | None = None, tier_tokens: int = TIER_TOKENS) -> Column:
    """Cost of a usage row that has the columns of with_tiers joined on.

    Cache writes of an hour cost twice the input rate. A model with a
    context_threshold is billed as a whole at the higher rates once the request's
    context is above it; any other bucket by bucket for what is above
    tier_tokens. Extra tokens count as output where extra_billed holds.
    """
    create, read = default_rates(F.col("input_rate"), F.col("cache_create_rate"), F.col("cache_read_rate"))
    hour = F.greatest(F.least(F.coalesce("cache_1h_tokens", F.lit(0)), F.col("cache_creation_tokens")), F.lit(0))
    five = F.col("cache_creation_tokens") - hour
    output = F.col("output_tokens") if extra_billed is None else F.col("output_tokens") + F.when(extra_billed, F.col("extra_total_tokens")).otherwise(0)
    context = saturating_add(F.col("input_tokens"), F.col("cache_read_tokens"), five, hour)
    above = {c: F.col(c) for c in ABOVE}
    parts = [
        (F.col("input_tokens"), F.col("input_rate"), above["input_above_rate"]), (output, F.col("output_rate"), above["output_above_rate"]), (five, create, above["cache_create_above_rate"]),
        (hour, F.col("input_rate") * HOUR_FACTOR, above["input_above_rate"] * HOUR_FACTOR), (F.col("cache_read_tokens"), read, above["cache_read_above_rate"]),
    ]
    threshold = F.col("context_threshold")
    whole, each = F.lit(0.0), F.lit(0.0)
    for tokens, base, higher in parts:
        whole, each = whole + whole_request(tokens, base, higher, context, threshold), each + marginal(tokens, base, higher, tier_tokens)
    total = F.when(threshold.isNotNull(), whole).otherwise(each)
    return F.coalesce(total * speed_factor(F.col("speed"), F.col("fast_factor")) if fast else total, F.lit(0.0))


@dataclass(frozen=True)
class CostPolicy:
    """How a source's cost follows from what it logged and from its tokens.

    display is logged, tokens or zero; auto is logged (else tokens), positive
    (logged if above 0, else tokens), tokens, or tokens_first (else logged, if
    above 0). extra_billed counts tokens beyond the known kinds as output.
    """

    display: str = "logged"
    auto: str = "logged"
    extra_billed: bool = False

    def cost(self, mode: str, logged: Column, tokens: Column) -> Column:
        zero, some = F.lit(0.0), F.when(logged > 0, logged)
        if mode == "calculate":
            return tokens
        if mode == "display":
            return {"logged": F.coalesce(logged, zero), "tokens": tokens, "zero": zero}[self.display]
        return {"logged": F.coalesce(logged, tokens), "positive": F.coalesce(some, tokens), "tokens": tokens, "tokens_first": F.when(tokens > 0, tokens).otherwise(F.coalesce(some, zero))}[self.auto]

    def uses_logged(self, mode: str, logged: Column) -> Column:
        """Whether a row's cost doesn't need a price."""
        if mode == "calculate" or (mode == "display" and self.display == "tokens") or (mode == "auto" and self.auto == "tokens"):
            return F.lit(False)
        return F.lit(True) if mode == "display" else logged.isNotNull() if self.auto == "logged" else F.coalesce(logged > 0, F.lit(False))


def by_policy(policies: dict[str, CostPolicy], pick) -> Column:  # noqa: ANN001
    """pick(policy) of each row's agent; agents without a policy have the default one."""
    out = None
    for agent, policy in sorted(policies.items()):
        out = F.when(F.col("agent") == agent, pick(policy)) if out is None else out.when(F.col("agent") == agent, pick(policy))
    return pick(CostPolicy()) if out is None else out.otherwise(pick(CostPolicy()))


def missing_price(tokens: Column, model: Column, rate: Column, logged: Column, mode: str) -> Column:
    """Tokens of a known model that could not be priced and had no logged cost to use."""
    if mode == "display":
        return F.lit(False)
    lacks = (tokens > 0) & model.isNotNull() & rate.isNull()
    return lacks & logged.isNull() if mode == "auto" else lacks


def non_cached(input_tokens: Column, cached: Column, created: Column) -> Column:
    return F.greatest(input_tokens - (cached + created), F.lit(0))


def clamped(input_tokens: Column, cached: Column, created: Column) -> tuple[Column, Column]:
    """Cached at most the input, created at most the rest."""
    c = F.least(cached, input_tokens)
    return c, F.least(created, input_tokens - c)


def fill_total(output: Column, extra: Column, known: Column, total: Column) -> tuple[Column, Column]:
    """(output, extra) so that a recorded total is accounted for.

    What is missing becomes output if there was none, else extra.
    """
    lacking = F.greatest(total - known, F.lit(0))
    return F.when(output == 0, lacking).otherwise(output), F.when(output == 0, extra).otherwise(extra + lacking)


def surcharge(base: Column, tier_costs: dict[str, tuple[Column, float]]) -> Column:
    """Base cost plus, for each service tier, its part of the cost times (factor - 1)."""
    for cost, factor in tier_costs.values():
        base = base + F.coalesce(cost, F.lit(0.0)) * (factor - 1)
    return base
