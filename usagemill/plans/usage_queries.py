"""Reports and operators over the usage tables, with the SQL they are checked against.

Prices here are made-up round numbers, the same in both engines; they stand in
for a price table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagemill.functions import dates, lenient, names
from usagemill.operators import aggregate, blocks, cost, dedupe, ordered, pricing, relate
from usagemill.schema import TOKENS, total_tokens
from usagemill.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: model, input, output, cache write, cache read rates per million tokens, fast factor.
PRICES = [
    ("orbit-4-pro", 15.0, 75.0, 18.75, 1.5, 2.0), ("orbit-4-mini", 1.0, 5.0, None, None, None), ("lumen-2", 3.0, 15.0, 3.75, 0.3, 1.5), ("quill-coder-7", 2.0, 8.0, None, 0.5, None),
    ("tarn-large", 4.0, 16.0, 5.0, 0.4, None), ("fathom-1.5", 0.5, 2.0, None, None, None), ("osprey_9b", 0.2, 0.4, None, None, None),
]
_PRICE_SQL = "price(model, ri, ro, rc, rr, ff) AS (VALUES " + ", ".join("(" + ", ".join("NULL::DOUBLE" if x is None else repr(x) if isinstance(x, str) else f"{x / (1e6 if i < 5 else 1):.12f}::DOUBLE" for i, x in enumerate(p)) + ")" for p in PRICES) + ")"

USAGE_SQL = """usage AS (
  SELECT record_id AS seq, src_file, sessionId AS session_id, project, message.id AS message_id, requestId AS request_id, epoch_ms(try_cast(timestamp AS TIMESTAMPTZ)) AS ts_ms,
    strftime(epoch_ms(epoch_ms(try_cast(timestamp AS TIMESTAMPTZ))), '%Y-%m-%d') AS date, nullif(message.model, '<synthetic>') AS model, message.usage.speed AS speed, costUSD AS cost_usd, version, isSidechain AS is_sidechain,
    coalesce(message.usage.input_tokens, 0) AS i, coalesce(message.usage.output_tokens, 0) AS o, coalesce(message.usage.cache_creation_input_tokens, 0) AS c, coalesce(message.usage.cache_read_input_tokens, 0) AS r,
    coalesce(message.usage.input_tokens, 0) + coalesce(message.usage.output_tokens, 0) + coalesce(message.usage.cache_creation_input_tokens, 0) + coalesce(message.usage.cache_read_input_tokens, 0) AS total
  FROM claude_usage WHERE try_cast(timestamp AS TIMESTAMPTZ) IS NOT NULL AND regexp_full_match(timestamp, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]{8,}(Z|[+-][0-9]{2}:[0-9]{2})')
)"""
PRICED_SQL = USAGE_SQL + ", " + _PRICE_SQL + """, priced AS (
  SELECT u.*, ri, coalesce((i * ri + o * ro + c * coalesce(rc, ri * 1.25) + r * coalesce(rr, ri * 0.1)) * CASE WHEN speed = 'fast' THEN coalesce(ff, 1.0) ELSE 1.0 END, 0.0) AS cost FROM usage u LEFT JOIN price p ON p.model = u.model
)"""
KEYED_SQL = USAGE_SQL + """, keyed AS (
  SELECT *, nullif(trim(message_id), '') AS m, CASE WHEN nullif(trim(request_id), '') IS NOT NULL THEN 'r:' || trim(request_id)
    WHEN regexp_matches(trim(message_id), '^(msg|resp)_') THEN 's:' || nullif(trim(session_id), '') ELSE 't:' || coalesce(nullif(trim(session_id), ''), '') || ':' || ts_ms END AS k FROM usage
), best AS (
  SELECT * FROM keyed WHERE m IS NULL OR k IS NULL UNION ALL
  SELECT * FROM keyed WHERE m IS NOT NULL AND k IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY m, k ORDER BY coalesce(is_sidechain, false), total DESC, coalesce(cost_usd, 0) DESC, speed IS NOT NULL DESC, seq) = 1
)"""
_SUMS = "sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, sum(c)::BIGINT AS cache_creation_tokens, sum(r)::BIGINT AS cache_read_tokens, sum(total)::BIGINT AS total_tokens, round(sum(cost), 9) AS total_cost, count(*) AS entries"


def query(sql: str | None):  # noqa: ANN201
    """Registers a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def price_table(s: SparkSession) -> DataFrame:
    df = s.createDataFrame(PRICES, "model string, i double, o double, c double, r double, fast_factor double")
    million = 1e6
    return df.select("model", (F.col("i") / million).alias("input_rate"), (F.col("o") / million).alias("output_rate"), (F.col("c") / million).alias("cache_create_rate"), (F.col("r") / million).alias("cache_read_rate"), "fast_factor")


def usage(s: SparkSession, d: str) -> DataFrame:
    return tables.first_agent(table(s, d, "claude_usage"))


def exact_priced(s: SparkSession, d: str) -> DataFrame:
    u = usage(s, d).join(pricing.bounded(cost.with_tiers(price_table(s))), "model", "left")
    return u.withColumn("cost", cost.computed())


def shown(df: DataFrame, *keys: str) -> DataFrame:
    """Report columns of a roll-up, money rounded for comparison."""
    return df.select(*keys, *[c for c in TOKENS if c != "extra_total_tokens"], "total_tokens", F.round("total_cost", 9).alias("total_cost"), "entries")


# Reports


@query(f"WITH {PRICED_SQL} SELECT date, {_SUMS} FROM priced GROUP BY date")
def usage_daily(s, d):
    return shown(aggregate.by_key(exact_priced(s, d), ["date"]), "date")


@query(f"WITH {PRICED_SQL} SELECT substr(date, 1, 7) AS period, {_SUMS} FROM priced GROUP BY 1")
def usage_monthly(s, d):
    return shown(aggregate.rebucket(aggregate.by_key(exact_priced(s, d), ["date"]), "month"), "period")


def _week_sql(shift: str) -> str:
    return f"WITH {PRICED_SQL} SELECT strftime(date::DATE - ({shift})::INTEGER, '%Y-%m-%d') AS period, {_SUMS} FROM priced GROUP BY 1"


@query(_week_sql("dayofweek(date::DATE)"))
def usage_weekly_sun(s, d):
    return shown(aggregate.rebucket(aggregate.by_key(exact_priced(s, d), ["date"]), "week", "sunday"), "period")


@query(_week_sql("(dayofweek(date::DATE) + 6) % 7"))
def usage_weekly_mon(s, d):
    return shown(aggregate.rebucket(aggregate.by_key(exact_priced(s, d), ["date"]), "week", "monday"), "period")


@query(f"WITH {PRICED_SQL} SELECT date, coalesce(project, 'unknown') AS project, {_SUMS} FROM priced GROUP BY 1, 2")
def usage_daily_by_project(s, d):
    u = exact_priced(s, d).withColumn("project", F.coalesce("project", F.lit("unknown")))
    return shown(aggregate.by_key(u, ["date", "project"]), "date", "project")


@query(f"WITH {PRICED_SQL} SELECT date, model, {_SUMS} FROM priced WHERE model IS NOT NULL GROUP BY 1, 2")
def usage_by_model_breakdown(s, d):
    return shown(aggregate.breakdown(exact_priced(s, d), ["date"]), "date", "model")


@query(f"""WITH {PRICED_SQL}, per AS (SELECT date, model, min(seq) AS f, round(sum(cost), 9) AS dear FROM priced WHERE model IS NOT NULL GROUP BY 1, 2)
SELECT date, string_agg(model, ',' ORDER BY f) AS models_used FROM per GROUP BY date""")
def models_used_first_seen(s, d):
    nested = aggregate.nested_breakdown(exact_priced(s, d), ["date"])
    return nested.filter(F.size("models_used") > 0).select("date", F.array_join("models_used", ",").alias("models_used"))


@query(f"""WITH {PRICED_SQL} SELECT session_id, {_SUMS}, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, arg_max(project, (ts_ms, -seq)) AS latest_project,
coalesce(array_to_string(list_sort(list_distinct(list(version) FILTER (WHERE version IS NOT NULL))), ','), '') AS versions FROM priced GROUP BY session_id""")
def usage_session(s, d):
    out = aggregate.sessions(exact_priced(s, d), ["session_id"])
    return shown(out.withColumn("session", F.col("session_id")), "session_id", "first_ms", "last_ms", "latest_project", "versions")


@query(f"""WITH {PRICED_SQL}, s AS (SELECT session_id, sum(total)::BIGINT AS total_tokens, round(sum(cost), 9) AS total_cost FROM priced GROUP BY 1)
SELECT * FROM s WHERE total_tokens > 0 AND session_id IS NOT NULL ORDER BY total_cost DESC, session_id LIMIT 20""")
def top_sessions_by_cost(s, d):
    out = aggregate.sessions(exact_priced(s, d), ["session_id"]).select("session_id", "total_tokens", F.round("total_cost", 9).alias("total_cost"))
    return ordered.top(out.filter((F.col("total_tokens") > 0) & F.col("session_id").isNotNull()), [F.desc("total_cost"), F.col("session_id")], 20)


@query(f"""WITH {USAGE_SQL}, big AS (SELECT session_id FROM usage WHERE session_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, session_id LIMIT 1)
SELECT seq, ts_ms, model, i AS input_tokens, o AS output_tokens FROM usage WHERE session_id = (SELECT session_id FROM big)""")
def session_detail(s, d):
    u = usage(s, d)
    big = ordered.top(u.filter(F.col("session_id").isNotNull()).groupBy("session_id").count(), [F.desc("count"), F.col("session_id")], 1).select("session_id")
    return u.join(F.broadcast(big), "session_id", "left_semi").select("seq", "ts_ms", "model", "input_tokens", "output_tokens")


@query(f"""WITH {PRICED_SQL}, d AS (SELECT date, {_SUMS} FROM priced GROUP BY date)
SELECT sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cache_creation_tokens)::BIGINT AS cache_creation_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens,
sum(total_tokens)::BIGINT AS total_tokens, round(sum(total_cost), 9) AS total_cost FROM d""")
def report_totals(s, d):
    t = aggregate.totals(aggregate.by_key(exact_priced(s, d), ["date"]))
    return t.select(*[c for c in TOKENS if c != "extra_total_tokens"], "total_tokens", F.round("total_cost", 9).alias("total_cost"))


_BOTH_SQL = USAGE_SQL + """, codex AS (
  SELECT record_id AS seq, payload.model AS model, strftime(epoch_ms(epoch_ms(try_cast(timestamp AS TIMESTAMPTZ))), '%Y-%m-%d') AS date, payload.usage.input_tokens + payload.usage.output_tokens AS total FROM codex_records WHERE try_cast(timestamp AS TIMESTAMPTZ) IS NOT NULL
), both_agents AS (SELECT 'claude' AS agent, date, model, total FROM usage UNION ALL SELECT 'codex', date, model, total FROM codex)"""


def both_agents(s: SparkSession, d: str) -> DataFrame:
    return relate.union_all({"claude": usage(s, d), "codex": tables.second_agent(table(s, d, "codex_records"))}).withColumn("cost", F.lit(0.0))


@query(f"""WITH {_BOTH_SQL} SELECT substr(date, 1, 7) AS period, agent, model, sum(total)::BIGINT AS total_tokens, count(*) AS entries,
CASE grouping(substr(date, 1, 7), agent, model) WHEN 7 THEN 0 WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS level FROM both_agents GROUP BY ROLLUP (substr(date, 1, 7), agent, model)""")
def unified_rollup(s, d):
    return aggregate.unified(both_agents(s, d), "month").select("period", "agent", "model", "total_tokens", "entries", "level")


@query(f"WITH {_BOTH_SQL} SELECT date, agent, sum(total)::BIGINT AS total_tokens, count(*) AS entries FROM both_agents GROUP BY 1, 2")
def by_agent_daily(s, d):
    return aggregate.by_key(both_agents(s, d), ["date", "agent"]).select("date", "agent", "total_tokens", "entries")


# Cost


def _mode_sql(mode: str) -> str:
    c = {"display": "coalesce(cost_usd, 0.0)", "auto": "coalesce(cost_usd, cost)", "calculate": "cost"}[mode]
    return f"WITH {PRICED_SQL} SELECT project, round(sum({c}), 9) AS cost FROM priced GROUP BY project"


def _by_mode(mode: str):  # noqa: ANN202
    def run(s, d):
        p = exact_priced(s, d)
        return p.groupBy("project").agg(F.round(F.sum(cost.by_mode(mode, F.col("cost_usd"), F.col("cost"))), 9).alias("cost"))

    run.__name__ = f"cost_mode_{mode}"
    return run


for _m in ("display", "auto", "calculate"):
    query(_mode_sql(_m))(_by_mode(_m))


@query("""SELECT l_returnflag, round(sum(CASE WHEN l_extendedprice > 50000 THEN 50000 * 0.003 + (l_extendedprice - 50000) * 0.006 ELSE l_extendedprice * 0.003 END), 4) AS marginal,
round(sum(l_extendedprice * CASE WHEN l_extendedprice + l_quantity > 50000 THEN 0.006 ELSE 0.003 END), 4) AS whole FROM lineitem GROUP BY 1""")
def cost_tiers(s, d):
    x = F.col("l_extendedprice")
    m = cost.marginal(x, F.lit(0.003), F.lit(0.006), 50000)
    w = cost.whole_request(x, F.lit(0.003), F.lit(0.006), x + F.col("l_quantity"), F.lit(50000))
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(m), 4).alias("marginal"), F.round(F.sum(w), 4).alias("whole"))


@query(f"WITH {USAGE_SQL} SELECT seq, CASE WHEN c % 2 = 0 THEN c // 2 + c // 4 ELSE c END AS created, round((c // 4)::DOUBLE * 0.000003::DOUBLE * 2.0::DOUBLE, 9)::DOUBLE AS hour_cost FROM usage")
def cost_cache_lifetimes(s, d):
    c = F.col("cache_creation_tokens")
    five, hour = F.when(c % 2 == 0, F.expr("cache_creation_tokens div 2")), F.when(c % 2 == 0, F.expr("cache_creation_tokens div 4"))
    return usage(s, d).select("seq", cost.cache_created(c, five, hour).alias("created"), F.round(cost.one_hour(F.expr("cache_creation_tokens div 4"), F.lit(0.000003)), 9).alias("hour_cost"))


@query(f"WITH {PRICED_SQL} SELECT speed, round(sum(cost), 9) AS cost FROM priced GROUP BY speed")
def cost_by_speed(s, d):
    return exact_priced(s, d).groupBy("speed").agg(F.round(F.sum("cost"), 9).alias("cost"))


@query(f"WITH {PRICED_SQL} SELECT model, count(*) AS rows FROM priced WHERE total > 0 AND model IS NOT NULL AND ri IS NULL AND cost_usd IS NULL GROUP BY 1")
def missing_pricing(s, d):
    p = exact_priced(s, d)
    lacks = cost.missing_price(total_tokens(), F.col("model"), F.col("input_rate"), F.col("cost_usd"), "auto")
    return p.filter(lacks).groupBy("model").agg(F.count(F.lit(1)).alias("rows"))


@query(f"WITH {PRICED_SQL} SELECT DISTINCT model FROM priced WHERE total > 0 AND model IS NOT NULL AND ri IS NULL")
def unpriced_models(s, d):
    p = exact_priced(s, d)
    return aggregate.unpriced(p.withColumn("lacks", cost.missing_price(total_tokens(), F.col("model"), F.col("input_rate"), F.col("cost_usd"), "calculate")), "lacks")


@query("""SELECT record_id, CASE WHEN o = 0 THEN greatest(t - k, 0) ELSE o END AS output, CASE WHEN o = 0 THEN 0 ELSE greatest(t - k, 0) END AS extra FROM (
  SELECT record_id, payload.usage.output_tokens AS o, payload.usage.total_tokens + record_id % 3 AS t, payload.usage.input_tokens + payload.usage.output_tokens AS k FROM codex_records)""")
def total_token_fallback(s, d):
    u = table(s, d, "codex_records").select("record_id", F.col("payload.usage.output_tokens").alias("o"), (F.col("payload.usage.total_tokens") + F.col("record_id") % 3).alias("t"), (F.col("payload.usage.input_tokens") + F.col("payload.usage.output_tokens")).alias("k"))
    out, extra = cost.fill_total(F.col("o"), F.lit(0).cast("bigint"), F.col("k"), F.col("t"))
    return u.select("record_id", out.alias("output"), extra.alias("extra"))


@query("""SELECT payload.model AS model, sum(greatest(payload.usage.input_tokens - least(payload.usage.cached_input_tokens, payload.usage.input_tokens), 0))::BIGINT AS non_cached,
sum(payload.usage.output_tokens) FILTER (WHERE payload.usage.input_tokens > 20000)::BIGINT AS long_output FROM codex_records GROUP BY 1""")
def conditional_sums(s, d):
    i, c = F.col("payload.usage.input_tokens"), F.col("payload.usage.cached_input_tokens")
    cached, _ = cost.clamped(i, c, F.lit(0))
    return table(s, d, "codex_records").groupBy(F.col("payload.model").alias("model")).agg(F.sum(cost.non_cached(i, cached, F.lit(0))).alias("non_cached"), F.sum(F.when(i > 20000, F.col("payload.usage.output_tokens"))).alias("long_output"))


# Prices


@query(f"WITH {USAGE_SQL}, {_PRICE_SQL} SELECT DISTINCT u.model, p.model AS key FROM usage u JOIN price p ON p.model = u.model")
def price_exact(s, d):
    return pricing.exact(usage(s, d).select("model").distinct(), price_table(s))


@query(f"WITH {USAGE_SQL}, {_PRICE_SQL}, a(alias, name) AS (VALUES ('kestrel-r2', 'lumen-2'), ('osprey-9b', 'osprey_9b')) SELECT DISTINCT u.model, p.model AS key FROM usage u LEFT JOIN a ON a.alias = u.model JOIN price p ON p.model = coalesce(a.name, u.model)")
def price_alias(s, d):
    return pricing.by_alias(usage(s, d).select("model").distinct(), price_table(s), {"kestrel-r2": "lumen-2", "osprey-9b": "osprey_9b"})


@query(f"WITH {USAGE_SQL}, {_PRICE_SQL}, f AS (SELECT replace(replace(model, '.', '-'), '@', '-') AS form, min(model) AS key FROM price GROUP BY 1 HAVING count(*) = 1) SELECT DISTINCT u.model, f.key FROM usage u JOIN f ON f.form = replace(replace(u.model, '.', '-'), '@', '-')")
def price_normalized(s, d):
    return pricing.by_normal_form(usage(s, d).select("model").distinct(), price_table(s))


@query(f"""WITH {USAGE_SQL}, {_PRICE_SQL}, m AS (SELECT DISTINCT model FROM usage WHERE model IS NOT NULL),
hit AS (SELECT m.model, p.model AS key FROM m JOIN price p ON regexp_matches(m.model, '(^|[^A-Za-z0-9])' || replace(p.model, '.', '[.]') || '($|[^A-Za-z0-9])') AND NOT regexp_matches(m.model, replace(p.model, '.', '[.]') || '[-.][0-9]{{1,7}}($|[^0-9])'))
SELECT model, key FROM hit QUALIFY row_number() OVER (PARTITION BY model ORDER BY length(key) DESC, key) = 1""")
def price_like(s, d):
    return pricing.by_likeness(usage(s, d).select("model").distinct().filter("model is not null"), price_table(s))


@query(f"""WITH {USAGE_SQL}, {_PRICE_SQL}, c AS (SELECT DISTINCT model FROM usage WHERE model IS NOT NULL),
e AS (SELECT model, 0 AS pos, 'vendor/' || model AS key FROM c UNION ALL SELECT model, 1, model FROM c UNION ALL SELECT model, 2, regexp_replace(model, '-(fast|preview|free)$', '') FROM c)
SELECT e.model, arg_min(e.key, pos) AS key FROM e JOIN price p ON p.model = e.key WHERE p.ri > 0 GROUP BY e.model""")
def price_candidates_first(s, d):
    m = F.col("model")
    rows = usage(s, d).select("model").distinct().filter(m.isNotNull()).withColumn("candidates", F.array(F.concat(F.lit("vendor/"), m), m, F.regexp_replace(m, "-(fast|preview|free)$", "")))
    return pricing.first_candidate(rows, "model", "candidates", price_table(s), "input_rate", True).select("model", "key")


_SCHEDULE = [("orbit-4-pro", None, 1736640000000, False, 1.0), ("orbit-4-pro", 1736640000000, None, False, 2.0), ("orbit-4-pro", 1736640000000, None, True, 3.0), ("lumen-2", None, None, False, 5.0)]


@query(f"""WITH {USAGE_SQL}, t AS (SELECT seq, model, ts_ms, extract(isodow FROM epoch_ms(ts_ms)) <= 5 AND (extract(hour FROM epoch_ms(ts_ms)) BETWEEN 1 AND 3 OR extract(hour FROM epoch_ms(ts_ms)) BETWEEN 6 AND 9) AS peak FROM usage)
SELECT seq, CASE WHEN model = 'lumen-2' THEN 5.0 WHEN model = 'orbit-4-pro' AND ts_ms < 1736640000000 THEN 1.0 WHEN model = 'orbit-4-pro' AND peak THEN 3.0 WHEN model = 'orbit-4-pro' THEN 2.0 END::DOUBLE AS rate FROM t""")
def price_schedule_peak(s, d):
    schedule = s.createDataFrame(_SCHEDULE, "model string, from_ms bigint, to_ms bigint, peak boolean, rate double")
    return pricing.at_time(usage(s, d).select("seq", "model", "ts_ms"), schedule).select("seq", "rate")


@query(f"""WITH {USAGE_SQL}, rel(released_on, name) AS (VALUES ('2025-01-05', 'first'), ('2025-01-12', 'second'), ('2025-01-20', 'third'))
SELECT u.date, r.name AS release, count(*) AS rows FROM usage u ASOF LEFT JOIN rel r ON r.released_on <= u.date GROUP BY 1, 2""")
def price_asof_release(s, d):
    rel = s.createDataFrame([("2025-01-05", "first"), ("2025-01-12", "second"), ("2025-01-20", "third")], "released_on string, name string")
    return pricing.as_of(usage(s, d).select("date"), rel).groupBy("date", "release").agg(F.count(F.lit(1)).alias("rows"))


@query(f"""WITH {_PRICE_SQL}, o(model, oi, oo) AS (VALUES ('lumen-2', 0.000006::DOUBLE, NULL::DOUBLE), ('fathom-1.5', NULL, 0.00001))
SELECT p.model, round(coalesce(oi, ri) * 1e6, 6) AS input_rate, round(coalesce(oo, ro) * 1e6, 6) AS output_rate, round(rc * coalesce(oi / ri, 1.0) * 1e6, 6) AS cache_create_rate, round(rr * coalesce(oi / ri, 1.0) * 1e6, 6) AS cache_read_rate FROM price p LEFT JOIN o ON o.model = p.model""")
def price_override_scaled(s, d):
    o = s.createDataFrame([("lumen-2", 0.000006, None, None, None), ("fathom-1.5", None, 0.00001, None, None)], "model string, input_rate double, output_rate double, cache_create_rate double, cache_read_rate double")
    out = pricing.overridden(price_table(s), o)
    return out.select("model", *[F.round(F.col(c) * 1e6, 6).alias(c) for c in cost.RATES])


# Filters, casts, names


@query(f"WITH {USAGE_SQL} SELECT date, count(*) AS rows FROM usage WHERE date BETWEEN '2025-01-05' AND '2025-01-12' GROUP BY 1")
def date_window_inclusive(s, d):
    return usage(s, d).filter(dates.in_dates(F.col("date"), "20250105", "2025-01-12")).groupBy("date").agg(F.count(F.lit(1)).alias("rows"))


@query(f"WITH {USAGE_SQL} SELECT count(*) AS rows FROM usage WHERE replace(date, '-', '') >= '202501' AND replace(date, '-', '') <= '20250115'")
def date_window_partial(s, d):
    return usage(s, d).filter(dates.in_dates(F.col("date"), "202501", "2025-01-15")).agg(F.count(F.lit(1)).alias("rows"))


@query(f"WITH {USAGE_SQL} SELECT strftime(timezone('America/New_York', to_timestamp(ts_ms / 1000.0)), '%Y-%m-%d') AS day, count(*) AS rows FROM usage WHERE ts_ms >= 1736139600000 AND ts_ms < 1736744400000 GROUP BY 1")
def instant_window_zone(s, d):
    zone = "America/New_York"
    u = usage(s, d).filter(dates.in_instants(F.col("ts_ms"), "2025-01-06", "2025-01-12", zone))
    return u.groupBy(dates.report_date(F.col("ts_ms"), zone).alias("day")).agg(F.count(F.lit(1)).alias("rows"))


@query(f"""WITH {USAGE_SQL}, top AS (SELECT max(date) AS last FROM usage)
SELECT strftime(date::DATE - ((dayofweek(date::DATE) + 6) % 7)::INTEGER, '%Y-%m-%d') AS week, count(*) AS rows FROM usage, top WHERE date::DATE >= last::DATE - ((dayofweek(last::DATE) + 6) % 7)::INTEGER - 7 GROUP BY 1""")
def last_n_periods(s, d):
    from datetime import date

    u = usage(s, d)
    last = u.agg(F.max("date")).first()[0]
    since = dates.last_periods(date.fromisoformat(last), "week", 2) if last else None
    return u.filter(dates.in_dates(F.col("date"), since, None)).groupBy(dates.week_start(F.col("date")).alias("week")).agg(F.count(F.lit(1)).alias("rows"))


@query("""SELECT CASE WHEN (version IS NULL OR regexp_matches(version, '^[0-9]+[.][0-9]+[.][0-9]+')) AND coalesce(trim(sessionId) <> '', true) AND coalesce(trim(requestId) <> '', true) AND coalesce(trim(message.id) <> '', true) AND coalesce(trim(message.model) <> '', true) THEN 'valid' ELSE 'left out' END AS verdict, count(*) AS rows FROM claude_usage GROUP BY 1""")
def row_validity(s, d):
    from usagemill.sources.agents import valid_line

    return table(s, d, "claude_usage").groupBy(F.when(valid_line(), "valid").otherwise("left out").alias("verdict")).agg(F.count(F.lit(1)).alias("rows"))


@query(f"WITH {USAGE_SQL} SELECT count(*) AS rows FROM usage WHERE total > 0 OR coalesce(cost_usd, 0) > 0")
def drop_zero_usage(s, d):
    from usagemill.sources.agents import used

    return used(usage(s, d), cost_only=True).agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k, CASE WHEN event_type = '' THEN NULL ELSE trim(event_type) END AS kind FROM events")
def json_extract_props(s, d):
    return table(s, d, "events").select("event_id", lenient.lenient_count(F.get_json_object("props", "$.k")).alias("k"), lenient.non_empty(F.col("event_type")).alias("kind"))


@query("SELECT record_id, coalesce(CASE WHEN regexp_full_match(x, '\\s*[+]?[0-9]{1,17}\\s*') THEN trim(x)::BIGINT END, 0) AS n FROM (SELECT record_id, layout, CASE WHEN layout = 'cline_csv' THEN regexp_extract(raw, '^[^,\"]*,[^,\"]*,[^,\"]*,[^,\"]*,[^,\"]*,[^,\"]*,([^,\"]*),', 1) END AS x FROM raw_records) WHERE layout = 'cline_csv'")
def lenient_cast(s, d):
    x = F.regexp_extract("raw", '^[^,"]*,[^,"]*,[^,"]*,[^,"]*,[^,"]*,[^,"]*,([^,"]*),', 1)
    short = F.when(F.length(F.trim(x)) <= 18, x)
    return table(s, d, "raw_records").filter(F.col("layout") == "cline_csv").select("record_id", lenient.lenient_count(F.coalesce(short, F.lit(""))).alias("n"))


@query("""SELECT src_file, CASE WHEN contains(src_file, '/subagents/') THEN list_extract(string_split(src_file, '/'), (list_position(string_split(src_file, '/'), 'subagents') - 1)::BIGINT) ELSE regexp_replace(regexp_extract(src_file, '[^/]+$'), '[.]jsonl$', '') END AS session, regexp_extract(src_file, '^projects/([^/]+)', 1) AS project, count(*) AS rows FROM claude_usage GROUP BY 1, 2, 3""")
def path_identity(s, d):
    f = F.col("src_file")
    return table(s, d, "claude_usage").groupBy("src_file", names.session_of(f).alias("session"), names.project_of(f).alias("project")).agg(F.count(F.lit(1)).alias("rows"))


@query(f"WITH {USAGE_SQL} SELECT DISTINCT model, regexp_replace(model, '-20[0-9]{{6}}$', '') AS stem, CASE WHEN speed = 'fast' AND NOT suffix(model, '-fast') THEN model || '-fast' ELSE model END AS shown FROM usage WHERE model IS NOT NULL")
def model_names(s, d):
    m = F.col("model")
    return usage(s, d).filter(m.isNotNull()).select("model", names.without_date(m).alias("stem"), names.display_model(m, F.col("speed")).alias("shown")).distinct()


# Order and blocks


_SPAN = 5 * blocks.HOUR

def _block_cte(span: int) -> str:
    return f"""WITH RECURSIVE {USAGE_SQL}, ev AS (
  SELECT project, ts_ms, total, row_number() OVER (PARTITION BY project ORDER BY ts_ms, seq) AS n FROM usage
), walk AS (
  SELECT project, n, ts_ms, total, ts_ms // 3600000 * 3600000 AS block_ms, 0 AS no FROM ev WHERE n = 1
  UNION ALL
  SELECT e.project, e.n, e.ts_ms, e.total, CASE WHEN e.ts_ms - w.block_ms > {span} OR e.ts_ms - w.ts_ms > {span} THEN e.ts_ms // 3600000 * 3600000 ELSE w.block_ms END,
    CASE WHEN e.ts_ms - w.block_ms > {span} OR e.ts_ms - w.ts_ms > {span} THEN w.no + 1 ELSE w.no END
  FROM walk w JOIN ev e ON e.project = w.project AND e.n = w.n + 1
), found AS (
  SELECT project, block_ms, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, block_ms + {span} AS end_ms, count(*) AS entries, sum(total)::BIGINT AS total FROM walk GROUP BY project, no, block_ms
)"""


def _blocks(s: SparkSession, d: str, span: int = _SPAN) -> DataFrame:
    u = usage(s, d).select("project", "ts_ms", total_tokens().alias("total"))
    return blocks.blocks(u.filter(F.col("project").isNotNull()), ["project"], span, ["total"])


@query(_block_cte(_SPAN) + " SELECT project, block_ms, first_ms, last_ms, end_ms, entries, total FROM found")
def blocks_5h(s, d):
    return _blocks(s, d).select("project", "block_ms", "first_ms", "last_ms", "end_ms", "entries", "total")


@query(_block_cte(1_080_000) + " SELECT project, block_ms, first_ms, last_ms, entries, total FROM found")
def blocks_18min(s, d):
    return _blocks(s, d, 1_080_000).select("project", "block_ms", "first_ms", "last_ms", "entries", "total")


@query(_block_cte(_SPAN) + f", g AS (SELECT project, first_ms, lag(last_ms) OVER (PARTITION BY project ORDER BY first_ms) AS p FROM found) SELECT project, p + {_SPAN} AS gap_start_ms, first_ms AS gap_end_ms FROM g WHERE first_ms - p > {_SPAN}")
def block_gaps(s, d):
    return blocks.gaps(_blocks(s, d), ["project"])


@query(_block_cte(_SPAN) + " SELECT project, first_ms, CASE WHEN last_ms > first_ms THEN round(total / ((last_ms - first_ms) / 60000.0), 4) END AS per_minute, CASE WHEN total > 200000 THEN 'exceeds' WHEN total > 160000 THEN 'warning' ELSE 'ok' END AS status FROM found")
def burn_rate_and_limit(s, d):
    rated = blocks.burn_rate(_blocks(s, d), "total", "total")
    return rated.select("project", "first_ms", F.round("tokens_per_minute", 4).alias("per_minute"), blocks.limit_status(F.col("total"), 200000).alias("status"))


@query(_block_cte(_SPAN) + ", t AS (SELECT max(last_ms) + 60000 AS now FROM found) SELECT max(total) FILTER (WHERE NOT (now - last_ms < 18000000 AND now < end_ms)) AS max_tokens FROM found, t")
def largest_finished_block(s, d):
    found = _blocks(s, d)
    last = found.agg(F.max("last_ms")).first()[0]
    return blocks.largest_finished(found, "total", (last or 0) + 60_000)


@query(f"""WITH {USAGE_SQL}, p AS (SELECT project, ts_ms, ts_ms - lag(ts_ms) OVER (PARTITION BY project ORDER BY ts_ms) > {_SPAN} AS opens FROM usage)
SELECT project, coalesce(max(ts_ms) FILTER (WHERE opens), min(ts_ms)) AS anchor_ms FROM p GROUP BY project""")
def latest_block_anchor(s, d):
    return blocks.anchor(usage(s, d), ["project"])


_CUM = "SELECT record_id, src_file, payload.model AS model, sum(payload.usage.total_tokens) OVER (PARTITION BY src_file ORDER BY line_no, record_id) AS cum, line_no FROM codex_records"


def _cumulative(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("src_file").orderBy("line_no", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(s, d, "codex_records").select("record_id", "src_file", "line_no", F.col("payload.model").alias("model"), F.sum("payload.usage.total_tokens").over(w).alias("cum"))


@query(f"WITH c AS ({_CUM.replace('record_id)', 'record_id ROWS UNBOUNDED PRECEDING)')}) SELECT record_id, greatest(cum - coalesce(lag(cum) OVER (PARTITION BY src_file ORDER BY line_no, record_id), 0), 0)::BIGINT AS delta FROM c")
def cumulative_to_delta(s, d):
    return ordered.cumulative_to_delta(_cumulative(s, d), ["src_file"], ["line_no", "record_id"], ["cum"]).select("record_id", F.col("delta_cum").alias("delta"))


@query("SELECT record_id, last_value(payload.model IGNORE NULLS) OVER (PARTITION BY src_file ORDER BY line_no, record_id ROWS UNBOUNDED PRECEDING) AS model FROM codex_records")
def carry_forward_model(s, d):
    df = table(s, d, "codex_records").select("record_id", "src_file", "line_no", F.col("payload.model").alias("model"))
    return ordered.carry_forward(df, ["src_file"], ["line_no", "record_id"], "model", "carried").select("record_id", F.col("carried").alias("model"))


@query("""WITH n AS (SELECT record_id, src_file, user_key, k, row_number() OVER (PARTITION BY src_file, user_key, k ORDER BY record_id) AS o FROM (SELECT record_id, src_file, coalesce(payload.model, '~') AS user_key, payload.usage.total_tokens AS k FROM codex_records))
SELECT min(record_id) AS record_id, user_key AS model, k AS total FROM n GROUP BY user_key, k, o""")
def occurrence_dedupe(s, d):
    df = table(s, d, "codex_records").select("record_id", "src_file", F.coalesce("payload.model", F.lit("~")).alias("model"), F.col("payload.usage.total_tokens").alias("total"))
    return dedupe.across_files(df, ["model", "total"], "src_file", "record_id").select("record_id", "model", "total")


@query("SELECT record_id, min(payload.usage.total_tokens) OVER (PARTITION BY src_file ORDER BY line_no, record_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS floor FROM codex_records")
def suffix_min_tokens(s, d):
    df = table(s, d, "codex_records").select("record_id", "src_file", "line_no", F.col("payload.usage.total_tokens").alias("t"))
    return ordered.suffix_min(df, ["src_file"], ["line_no", "record_id"], "t", "floor").select("record_id", "floor")


@query(f"""WITH {USAGE_SQL}, m AS (SELECT seq, session_id, ts_ms, ts_ms - coalesce(lag(ts_ms) OVER (PARTITION BY session_id ORDER BY ts_ms, seq), min(ts_ms) OVER (PARTITION BY session_id)) > 60000 AS b FROM usage WHERE session_id IS NOT NULL),
r AS (SELECT session_id, bool_or(b) OVER (PARTITION BY session_id ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS broken FROM m) SELECT session_id, count(*) FILTER (WHERE NOT broken) AS leading FROM r GROUP BY 1""")
def burst_skip(s, d):
    from pyspark.sql import Window

    u = usage(s, d).filter(F.col("session_id").isNotNull()).withColumn("start", F.min("ts_ms").over(Window.partitionBy("session_id")))
    return ordered.leading_burst(u, ["session_id"], ["ts_ms", "seq"], "ts_ms", "start", 60_000).groupBy("session_id").agg(F.count_if("in_burst").alias("leading"))


@query(f"WITH {USAGE_SQL} SELECT session_id, arg_max(model, (ts_ms, seq)) AS model, arg_max(i + c + r, (ts_ms, seq)) AS context FROM usage WHERE session_id IS NOT NULL AND model IS NOT NULL GROUP BY 1")
def last_context(s, d):
    u = usage(s, d).filter("session_id is not null and model is not null").withColumn("context", F.col("input_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens"))
    return ordered.last_of(u, ["session_id"], ["ts_ms", "seq"], ["model", "context"])


# One of many


@query(f"WITH {KEYED_SQL} SELECT seq, m AS message, total FROM best")
def dedupe_best_row(s, d):
    return dedupe.best_usage(usage(s, d)).select("seq", lenient.non_empty(F.col("message_id")).alias("message"), total_tokens().alias("total"))


@query(f"""WITH {KEYED_SQL} SELECT seq FROM best b WHERE NOT (coalesce(is_sidechain, false) AND m IS NOT NULL AND EXISTS (
  SELECT 1 FROM best x WHERE NOT (coalesce(x.is_sidechain, false) AND x.m IS NOT NULL) AND x.message_id = b.message_id AND x.session_id = b.session_id AND (x.ts_ms = b.ts_ms OR (coalesce(trim(x.request_id), '') = '' AND coalesce(trim(b.request_id), '') = ''))))""")
def dedupe_sidechain_replays(s, d):
    return dedupe.without_replays(usage(s, d)).select("seq")


@query("SELECT max(record_id) AS record_id, payload.response_id AS response_id FROM codex_records WHERE payload.response_id IS NOT NULL GROUP BY 2 UNION ALL SELECT record_id, NULL FROM codex_records WHERE payload.response_id IS NULL")
def dedupe_last_wins(s, d):
    df = table(s, d, "codex_records").select("record_id", F.col("payload.response_id").alias("response_id"))
    return dedupe.keep_last(df, [F.col("response_id")], "record_id")


@query(f"WITH {USAGE_SQL} SELECT count(*) AS rows FROM usage u WHERE NOT EXISTS (SELECT 1 FROM usage l WHERE l.seq % 2 = 0 AND l.session_id = u.session_id AND l.date = u.date)")
def session_day_anti_join(s, d):
    u = usage(s, d)
    return relate.not_counted(u, u.filter(F.col("seq") % 2 == 0), ["session_id", "date"]).agg(F.count(F.lit(1)).alias("rows"))


@query(f"""WITH {USAGE_SQL}, t AS (SELECT seq, message_id, request_id, CASE WHEN speed = 'fast' THEN 0 WHEN speed = 'standard' THEN 1 ELSE 2 END AS tier FROM usage)
SELECT seq FROM t WHERE NOT EXISTS (SELECT 1 FROM t a WHERE a.tier < t.tier AND (a.message_id = t.message_id OR a.request_id = t.request_id))""")
def source_precedence(s, d):
    u = usage(s, d).select("seq", "message_id", "request_id", "speed")
    tiers = [u.filter("speed = 'fast'"), u.filter("speed = 'standard'"), u.filter("speed is null or speed not in ('fast', 'standard')")]
    return relate.precedence(tiers, ["message_id", "request_id"]).select("seq")


@query("""WITH f AS (SELECT src_file AS pair, line_no, record_id, coalesce(payload.model, '~') AS x FROM codex_records),
p AS (SELECT pair, x, row_number() OVER (PARTITION BY pair ORDER BY record_id) AS pos FROM f), c AS (SELECT pair, x, record_id, row_number() OVER (PARTITION BY pair ORDER BY line_no, record_id) AS pos FROM f),
j AS (SELECT c.pair, c.record_id, c.pos, coalesce(c.x = p.x, false) AS same FROM c LEFT JOIN p ON p.pair = c.pair AND p.pos = c.pos)
SELECT record_id, bool_and(same) OVER (PARTITION BY pair ORDER BY pos ROWS UNBOUNDED PRECEDING) AS replayed FROM j""")
def replay_prefix(s, d):
    f = table(s, d, "codex_records").select(F.col("src_file").alias("pair"), "line_no", "record_id", F.coalesce("payload.model", F.lit("~")).alias("x"))
    child = f.withColumn("at", F.struct("line_no", "record_id"))
    parent = f.select("pair", F.struct("record_id").alias("at"), "x")
    return relate.replayed_prefix(child, parent, "pair", "at", "x").select("record_id", "replayed")


# Windows over the event stream's table


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def window_tumbling(s, d):
    e = table(s, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "value")


@query("SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS b FROM events UNION ALL SELECT time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour' FROM events) GROUP BY 1")
def window_sliding(s, d):
    e = table(s, d, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL '6 hours' THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM n GROUP BY user_id, g""")
def session_gap_window(s, d):
    e = table(s, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return e.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


# More of the order, identity and text operators


@query("""WITH c AS (SELECT record_id, src_file, line_no, payload.usage.total_tokens AS last, sum(CASE WHEN record_id % 5 = 0 THEN 0 ELSE payload.usage.total_tokens END) OVER (PARTITION BY src_file ORDER BY line_no, record_id ROWS UNBOUNDED PRECEDING) AS cum FROM codex_records),
d AS (SELECT *, cum - coalesce(lag(cum) OVER (PARTITION BY src_file ORDER BY line_no, record_id), 0) AS rise FROM c)
SELECT record_id, (CASE WHEN rise <= 0 THEN 0 WHEN record_id % 2 = 0 THEN last ELSE rise END)::BIGINT AS usage FROM d""")
def last_or_delta(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("src_file").orderBy("line_no", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    t = F.col("payload.usage.total_tokens")
    df = table(s, d, "codex_records").select("record_id", "src_file", "line_no", F.when(F.col("record_id") % 2 == 0, t).alias("last"), F.sum(F.when(F.col("record_id") % 5 == 0, 0).otherwise(t)).over(w).alias("cum"))
    return ordered.last_or_delta(df, ["src_file"], ["line_no", "record_id"], "cum", "last").select("record_id", "usage")


@query("""WITH c AS (SELECT record_id, src_file, line_no, type = 'compacted' OR payload.model IS NOT NULL AS there, CASE WHEN type = 'compacted' THEN NULL ELSE payload.model END AS v FROM codex_records),
g AS (SELECT *, count(*) FILTER (WHERE there) OVER (PARTITION BY src_file ORDER BY line_no, record_id ROWS UNBOUNDED PRECEDING) AS grp FROM c)
SELECT record_id, first_value(CASE WHEN there THEN v END) OVER (PARTITION BY src_file, grp ORDER BY line_no, record_id) AS carried FROM g""")
def carry_known_value(s, d):
    m = F.col("payload.model")
    df = table(s, d, "codex_records").withColumn("there", (F.col("type") == "compacted") | m.isNotNull())
    return ordered.carry_known(df, ["src_file"], ["line_no", "record_id"], F.col("there"), F.when(F.col("type") != "compacted", m), "carried").select("record_id", "carried")


@query("""WITH x AS (SELECT record_id, src_file, line_no, payload.usage.total_tokens AS t FROM codex_records),
m AS (SELECT *, max(t) OVER (PARTITION BY src_file ORDER BY line_no, record_id ROWS UNBOUNDED PRECEDING) AS top, min(t) OVER (PARTITION BY src_file ORDER BY line_no, record_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low FROM x),
h AS (SELECT *, max(least(top, low)) OVER (PARTITION BY src_file ORDER BY line_no, record_id ROWS UNBOUNDED PRECEDING) AS held FROM m)
SELECT record_id, (held - coalesce(lag(held) OVER (PARTITION BY src_file ORDER BY line_no, record_id), 0))::BIGINT AS rise FROM h""")
def lasting_rise(s, d):
    df = table(s, d, "codex_records").select("record_id", "src_file", "line_no", F.col("payload.usage.total_tokens").alias("t"))
    return ordered.lasting_rise(df, ["src_file"], ["line_no", "record_id"], "t", "rise").select("record_id", "rise")


@query("SELECT count(DISTINCT trim(message.id)) AS gone FROM claude_usage s WHERE batch_id % 2 = 0 AND trim(message.id) <> '' AND NOT EXISTS (SELECT 1 FROM claude_usage l WHERE l.batch_id % 2 = 1 AND trim(l.message.id) = trim(s.message.id))")
def ledger_anti_join(s, d):
    """Stored messages (even batches) that are live (odd batches) no more."""
    from usagemill.operators.ledger import with_key

    u = with_key(table(s, d, "claude_usage").select("batch_id", "record_id", F.col("message.id").alias("message_id"), *[F.lit(None).cast("string").alias(x) for x in ("session_id", "model")], *[F.lit(None).cast("bigint").alias(x) for x in ("ts_ms", *TOKENS)], F.lit(None).cast("double").alias("cost_usd")))
    u = u.filter(lenient.non_empty(F.col("message_id")).isNotNull())
    gone = relate.not_counted(u.filter("batch_id % 2 = 0"), u.filter("batch_id % 2 = 1"), ["dedup_key"])
    return gone.agg(F.count_distinct("dedup_key").alias("gone"))


@query("SELECT src_file, arg_max(v, (p, -record_id)) AS value FROM (SELECT src_file, record_id, payload.model AS v, CASE type WHEN 'compacted' THEN 2 ELSE 1 END AS p FROM codex_records) WHERE v IS NOT NULL GROUP BY 1")
def best_attribute(s, d):
    df = table(s, d, "codex_records").select("src_file", "record_id", F.col("payload.model").alias("value"), F.when(F.col("type") == "compacted", 2).otherwise(1).alias("p"))
    return relate.best_attribute(df, "src_file", "value", "p", "record_id")


@query("SELECT record_id FROM codex_records r LEFT JOIN (SELECT src_file, max(record_id) AS cutoff FROM codex_records WHERE type = 'compacted' GROUP BY 1) c USING (src_file) WHERE cutoff IS NULL OR record_id > cutoff")
def after_cutoff(s, d):
    df = table(s, d, "codex_records")
    cutoffs = df.filter("type = 'compacted'").groupBy("src_file").agg(F.max("record_id").alias("cutoff"))
    return relate.after_cutoff(df, cutoffs, ["src_file"], "record_id", "cutoff").select("record_id")


@query("SELECT record_id FROM codex_records r LEFT JOIN (SELECT src_file, min(line_no) AS cutoff FROM codex_records WHERE payload.model = 'lumen-2' GROUP BY 1) c USING (src_file) WHERE cutoff IS NULL OR line_no > cutoff")
def copied_history(s, d):
    df = table(s, d, "codex_records")
    forks = df.filter(F.col("payload.model") == "lumen-2").groupBy("src_file").agg(F.min("line_no").alias("cutoff"))
    return relate.copied_history(df, forks, "src_file", "line_no").select("record_id")


@query("""WITH RECURSIVE pairs AS (SELECT DISTINCT record_id AS r, x FROM (SELECT record_id, 'm' || trim(message.id) AS x FROM claude_usage UNION ALL SELECT record_id, 'q' || trim(requestId) FROM claude_usage) WHERE length(x) > 1),
ln AS (SELECT DISTINCT a.r, b.r AS o FROM pairs a JOIN pairs b ON a.x = b.x),
reach AS (SELECT r, o FROM ln UNION SELECT reach.r, ln.o FROM reach JOIN ln ON ln.r = reach.o)
SELECT r AS record_id, min(o) AS component FROM reach GROUP BY r""")
def shared_identities(s, d):
    """Records that share a message id or a request id, directly or through others."""
    df = table(s, d, "claude_usage")
    m, q = lenient.non_empty(F.col("message.id")), lenient.non_empty(F.col("requestId"))
    pairs = df.select("record_id", F.concat(F.lit("m"), m).alias("x")).unionByName(df.select("record_id", F.concat(F.lit("q"), q).alias("x")))
    return relate.shared_identities(pairs, "record_id", "x")


@query("""WITH p AS (SELECT record_id, nullif(trim(payload.response_id), '') AS id, CASE type WHEN 'compacted' THEN 0 ELSE 1 END AS pr FROM codex_records)
SELECT record_id, id FROM p WHERE id IS NULL UNION ALL (SELECT record_id, id FROM p WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY pr, record_id) = 1)""")
def source_priority(s, d):
    df = table(s, d, "codex_records").select("record_id", "type", lenient.non_empty(F.col("payload.response_id")).alias("id"))
    parts = [df.filter("type = 'compacted'").drop("type"), df.filter("type <> 'compacted'").drop("type")]
    return dedupe.with_priority(parts, [F.col("id")], "record_id").select("record_id", "id")


@query("SELECT count(*) AS rows, count(DISTINCT (sessionId, timestamp, message.model, message.usage.input_tokens)) AS keys FROM claude_usage")
def content_keys(s, d):
    df = table(s, d, "claude_usage").select("sessionId", "timestamp", F.col("message.model").alias("model"), F.col("message.usage.input_tokens").alias("i"))
    return df.select(dedupe.content_key("sessionId", "timestamp", "model", "i").alias("k")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("k").alias("keys"))


@query("SELECT record_id, CASE WHEN v > 1e12 THEN v::BIGINT ELSE (v * 1000)::BIGINT END AS ms FROM (SELECT record_id, try_cast(trim(session.ts) AS BIGINT)::DOUBLE AS v FROM agent_clock WHERE regexp_full_match(trim(session.ts), '[0-9]{10}|[0-9]{13}'))")
def epoch_by_size(s, d):
    df = table(s, d, "agent_clock").select("record_id", F.trim("session.ts").alias("t")).filter(F.col("t").rlike(r"^(?:[0-9]{10}|[0-9]{13})\z"))
    return df.select("record_id", dates.epoch_ms(F.col("t").cast("bigint")).alias("ms"))


@query("SELECT DISTINCT project, regexp_replace(project, '^-(Users|home)-[^-]+-', '') AS shown, replace(project, '-', ' ') AS plain FROM claude_usage WHERE project IS NOT NULL")
def project_display_name(s, d):
    p = F.col("project")
    df = table(s, d, "claude_usage").filter(p.isNotNull()).select("project").distinct()
    return df.select("project", names.project_name(F.concat(F.lit("-Users-me-"), p)).alias("shown"), names.decoded(F.regexp_replace(p, "-", "%20")).alias("plain"))


@query("SELECT record_id, (record_id + 1700000000)::BIGINT AS reset_s FROM claude_usage WHERE isApiErrorMessage")
def reset_time_extract(s, d):
    df = table(s, d, "claude_usage").filter("isApiErrorMessage")
    text = F.concat(F.lit("usage limit reached|"), (F.col("record_id") + 1700000000).cast("string"))
    return df.select("record_id", names.reset_seconds(text).alias("reset_s"))


@query("SELECT line_id, coalesce(CASE WHEN json_type(raw, '$.message.usage.input_tokens') IN ('UBIGINT', 'BIGINT') THEN (raw->>'$.message.usage.input_tokens')::BIGINT END, 0) AS n FROM log_lines")
def json_counts(s, d):
    v = F.try_variant_get(F.try_parse_json("raw"), "$.message.usage.input_tokens", "variant")
    return table(s, d, "log_lines").select("line_id", lenient.json_count(v).alias("n"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(DISTINCT event_id) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2")
def stream_daily_totals(s, d):
    """The event table taken in as a stream, each event once, and counted by day."""
    from usagemill.session import fresh_path
    from usagemill.streaming.ingest import batch_sink, once

    source = s.read.parquet(f"{d}/events.parquet")
    to, cp = fresh_path(s, "stream"), fresh_path(s, "progress")
    stream = s.readStream.schema(source.schema).format("parquet").load(f"{d}/events.parquet*")
    timed = once(stream.withColumn("at", F.col("ts").cast("timestamp")), ["event_id"], "at", "10 minutes")
    timed.writeStream.foreachBatch(batch_sink(to)).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    kept = s.read.schema(timed.schema).option("recursiveFileLookup", "true").parquet(to)
    return kept.groupBy(F.date_format("at", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("value"))


@query(f"WITH {PRICED_SQL}, r AS (SELECT coalesce(project, 'unknown') AS project, date, sum(total)::BIGINT AS t FROM priced GROUP BY 1, 2) SELECT project, '[' || string_agg('{{\"date\":\"' || date || '\",\"t\":' || t || '}}', ',' ORDER BY date) || ']' AS json FROM r GROUP BY 1")
def project_json(s, d):
    from usagemill.plans.reports import by_project_json

    u = usage(s, d).withColumn("cost", F.lit(0.0)).withColumn("project", F.coalesce("project", F.lit("unknown")))
    rows = aggregate.by_key(u, ["date", "project"]).select("date", F.col("total_tokens").alias("t"), "project")
    out = by_project_json(rows)
    return out.select("project", F.regexp_replace("json", r',"project":"[^"]*"', "").alias("json"))
