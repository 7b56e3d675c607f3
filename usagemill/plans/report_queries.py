"""The reports themselves, from delivered records to rows, with the SQL they are checked against.

Each goes the whole way: valid rows, one copy of each message, replays of side
chains left out, names resolved (exact, alias, normal form, likeness), tiers,
logged costs, then the roll-up of plans/reports.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagemill.operators import dedupe
from usagemill.operators.blocks import HOUR
from usagemill.plans import reports
from usagemill.plans.reports import ReportOptions
from usagemill.plans.usage_queries import KEYED_SQL, query, table, usage
from usagemill.schema import TOKENS
from usagemill.session import cut
from usagemill.sources import tables

#: Made-up prices per million tokens: model, input, output, cache write, cache read, fast factor, the same four above a tier, context threshold.
TIERED = [
    ("orbit-4-pro", 15.0, 75.0, 18.75, 1.5, 2.0, 30.0, 112.5, 37.5, 3.0, None), ("orbit-4-mini", 1.0, 5.0, None, None, None, None, None, None, None, None), ("lumen-2", 3.0, 15.0, 3.75, 0.3, 1.5, 6.0, 22.5, 7.5, 0.6, 8000),
    ("quill-coder-7", 2.0, 8.0, None, 0.5, None, 4.0, None, None, None, None), ("tarn-large", 4.0, 16.0, 5.0, 0.4, None, None, None, None, None, None), ("osprey_9b", 0.2, 0.4, None, None, None, None, None, None, None, 4000),
]
ALIASES = {"kestrel-r2": "lumen-2"}
TIER = 4_000
OPTIONS = ReportOptions(aliases=ALIASES, tier_tokens=TIER)
_RATES = ("input_rate", "output_rate", "cache_create_rate", "cache_read_rate", "fast_factor", "input_above_rate", "output_above_rate", "cache_create_above_rate", "cache_read_above_rate")


def price_table(s: SparkSession) -> DataFrame:
    df = s.createDataFrame(TIERED, "model string, " + ", ".join(f"{c} double" for c in _RATES) + ", context_threshold bigint")
    return df.select("model", *[F.col(c) if c == "fast_factor" else (F.col(c) / 1e6).alias(c) for c in _RATES], "context_threshold")


def messages(s: SparkSession, d: str) -> DataFrame:
    """One row per message of the first agent, written once, as names are looked up ahead of the report."""
    return cut(dedupe.without_replays(usage(s, d)), "messages")


def _value(x: object, i: int) -> str:
    return "NULL::DOUBLE" if x is None else repr(x) if isinstance(x, str) else f"{x / (1 if i in (5, 10) else 1e6):.12f}::DOUBLE"


def _tier(tokens: str, base: str, above: str) -> str:
    whole = f"{tokens} * CASE WHEN i + r + c > th AND {above} IS NOT NULL THEN {above} ELSE {base} END"
    each = f"CASE WHEN {above} IS NOT NULL AND {tokens} > {TIER} THEN {TIER} * {base} + ({tokens} - {TIER}) * {above} ELSE {tokens} * {base} END"
    return f"CASE WHEN th IS NOT NULL THEN {whole} ELSE {each} END"


_VALUES = ", ".join("(" + ", ".join(_value(x, i) for i, x in enumerate(p)) + ")" for p in TIERED)
_MODELS = """price(model, ri, ro, rc, rr, ff, ai, ao, ac, ar, th) AS (VALUES """ + _VALUES + """),
names AS (SELECT DISTINCT model FROM source WHERE model IS NOT NULL),
forms AS (SELECT replace(replace(model, '.', '-'), '@', '-') AS form, min(model) AS key FROM price GROUP BY 1 HAVING count(*) = 1),
likes AS (SELECT m.model, p.model AS key FROM names m JOIN price p ON regexp_matches(m.model, '(^|[^A-Za-z0-9])' || replace(p.model, '.', '[.]') || '($|[^A-Za-z0-9])') AND NOT regexp_matches(m.model, replace(p.model, '.', '[.]') || '[-.][0-9]{1,7}($|[^0-9])')
  QUALIFY row_number() OVER (PARTITION BY m.model ORDER BY length(p.model) DESC, p.model) = 1),
named AS (SELECT m.model, coalesce(e.model, a.model, f.key, l.key) AS key FROM names m LEFT JOIN price e ON e.model = m.model LEFT JOIN price a ON a.model = CASE m.model WHEN 'kestrel-r2' THEN 'lumen-2' ELSE m.model END
  LEFT JOIN forms f ON f.form = replace(replace(m.model, '.', '-'), '@', '-') LEFT JOIN likes l ON l.model = m.model),
rated AS (SELECT s.*, p.* EXCLUDE (model) FROM source s LEFT JOIN named n ON n.model = s.model LEFT JOIN price p ON p.model = n.key),
costed AS (SELECT *, coalesce((""" + " + ".join([_tier("i", "ri", "ai"), _tier("o", "ro", "ao"), _tier("c", "coalesce(rc, ri * 1.25)", "ac"), _tier("r", "coalesce(rr, ri * 0.1)", "ar")]) + """) * CASE WHEN speed = 'fast' THEN coalesce(ff, 1.0) ELSE 1.0 END, 0.0) AS tokens_cost FROM rated),
final AS (SELECT *, coalesce(cost_usd, tokens_cost) AS cost, coalesce(cost_usd, 0.0) AS stored, total > 0 AND model IS NOT NULL AND ri IS NULL AND cost_usd IS NULL AS lacks FROM costed)"""
_SOURCE = KEYED_SQL + """, source AS (SELECT b.*, 'claude' AS agent FROM best b WHERE NOT (coalesce(is_sidechain, false) AND m IS NOT NULL AND EXISTS (
  SELECT 1 FROM best x WHERE NOT (coalesce(x.is_sidechain, false) AND x.m IS NOT NULL) AND x.message_id = b.message_id AND x.session_id = b.session_id AND (x.ts_ms = b.ts_ms OR (coalesce(trim(x.request_id), '') = '' AND coalesce(trim(b.request_id), '') = '')))))"""
FINAL = f"WITH {_SOURCE}, {_MODELS}"
_COLUMNS = "sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, sum(c)::BIGINT AS cache_creation_tokens, sum(r)::BIGINT AS cache_read_tokens, sum(total)::BIGINT AS total_tokens, round(sum(cost), 8) AS total_cost, round(sum(stored), 8) AS stored_cost, bool_or(lacks) AS missing_price, count(*) AS entries"


def shown(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[c for c in TOKENS if c != "extra_total_tokens"], "total_tokens", *[F.round(c, 8).alias(c) for c in ("total_cost", "stored_cost")], "missing_price", "entries")


def _period_sql(period: str, keys: str = "") -> str:
    return f"""{FINAL}, p AS (SELECT *, {period} AS period, coalesce(project, 'unknown') AS place FROM final),
per AS (SELECT period{keys}, model, min(seq) AS f, sum(cost) AS dear, sum(total)::BIGINT AS t FROM p WHERE model IS NOT NULL GROUP BY ALL),
lists AS (SELECT period{keys}, string_agg(model, ',' ORDER BY f) AS models_used, string_agg(model || '=' || t, ',' ORDER BY dear DESC, f) AS breakdown FROM per GROUP BY ALL),
sums AS (SELECT period{keys}, {_COLUMNS} FROM p GROUP BY ALL)
SELECT s.* {"RENAME (place AS project)" if keys else ""}, coalesce(models_used, '') AS models_used, coalesce(breakdown, '') AS breakdown FROM sums s LEFT JOIN lists USING (period{keys})"""


def _period(s: SparkSession, d: str, unit: str, o: ReportOptions = OPTIONS) -> DataFrame:
    out = reports.periods(messages(s, d), price_table(s), unit, o)
    told = F.array_join(F.transform("model_breakdowns", lambda b: F.concat(b["model"], F.lit("="), b["total_tokens"].cast("string"))), ",")
    out = out.withColumns({"models_used": F.coalesce(F.array_join("models_used", ","), F.lit("")), "breakdown": F.coalesce(told, F.lit(""))})
    keys = ["period", "project"] if o.by_project else ["period"]
    return shown(out.withColumn("_m", F.struct("models_used", "breakdown")), *keys, "models_used", "breakdown")


@query(_period_sql("date"))
def report_daily(s, d):
    return _period(s, d, "day")


@query(_period_sql("date", ", place"))
def report_daily_by_project(s, d):
    return _period(s, d, "day", ReportOptions(aliases=ALIASES, tier_tokens=TIER, by_project=True))


@query(_period_sql("strftime(date::DATE - dayofweek(date::DATE)::INTEGER, '%Y-%m-%d')"))
def report_weekly(s, d):
    return _period(s, d, "week")


@query(_period_sql("substr(date, 1, 7)"))
def report_monthly(s, d):
    return _period(s, d, "month")


@query(f"""{FINAL} SELECT session_id, project AS session_project, {_COLUMNS}, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, coalesce(array_to_string(list_sort(list_distinct(list(version) FILTER (WHERE version IS NOT NULL))), ','), '') AS versions
FROM final GROUP BY session_id, project HAVING sum(total) > 0""")
def report_session(s, d):
    return shown(reports.sessions(messages(s, d), price_table(s), OPTIONS), "session_id", "session_project", "first_ms", "last_ms", "versions")


@query(f"""{FINAL.replace("WITH usage", "WITH RECURSIVE usage", 1)}, cell AS (
  SELECT cell, row_number() OVER (ORDER BY cell) AS n, first_ms, last_ms, entries, tokens, cost FROM (
    SELECT (ts_ms + {HOUR - 1}) // {HOUR} AS cell, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS entries, sum(total)::BIGINT AS tokens, sum(cost) AS cost FROM final GROUP BY 1)
), walk AS (
  SELECT n, first_ms, last_ms, entries, tokens, cost, first_ms // {HOUR} * {HOUR} AS block_ms FROM cell WHERE n = 1
  UNION ALL
  SELECT e.n, e.first_ms, e.last_ms, e.entries, e.tokens, e.cost, CASE WHEN e.first_ms - w.block_ms > {5 * HOUR} OR e.first_ms - w.last_ms > {5 * HOUR} THEN e.first_ms // {HOUR} * {HOUR} ELSE w.block_ms END FROM walk w JOIN cell e ON e.n = w.n + 1
), found AS (SELECT block_ms, min(first_ms) AS first_ms, max(last_ms) AS last_ms, sum(entries)::BIGINT AS entries, sum(tokens)::BIGINT AS tokens, sum(cost) AS cost FROM walk GROUP BY block_ms),
top AS (SELECT max(tokens) AS most FROM found)
SELECT block_ms, first_ms, last_ms, entries, tokens, round(cost, 8) AS cost, CASE WHEN last_ms > first_ms THEN round(tokens / ((last_ms - first_ms) / 60000.0), 4) END AS per_minute,
CASE WHEN tokens > most THEN 'exceeds' WHEN tokens > most * 0.8 THEN 'warning' ELSE 'ok' END AS limit_status FROM found, top""")
def report_blocks(s, d):
    o = ReportOptions(aliases=ALIASES, tier_tokens=TIER, token_limit="max", now_ms=4_000_000_000_000)
    out = reports.billing_blocks(messages(s, d), price_table(s), o)
    status = F.when(F.col("tokens") > F.col("token_limit"), "exceeds").when(F.col("tokens") > F.col("token_limit") * 0.8, "warning").otherwise("ok")
    return out.select("block_ms", "first_ms", "last_ms", "entries", "tokens", F.round("cost", 8).alias("cost"), F.round("tokens_per_minute", 4).alias("per_minute"), status.alias("limit_status"))


_BOTH = _SOURCE.replace(", source AS (SELECT b.*", ", claude_rows AS (SELECT b.*") + """, codex_rows AS (
  SELECT 'codex' AS agent, record_id AS seq, payload.model AS model, NULL::VARCHAR AS speed, NULL::DOUBLE AS cost_usd, strftime(epoch_ms(epoch_ms(try_cast(timestamp AS TIMESTAMPTZ))), '%Y-%m-%d') AS date,
    coalesce(payload.usage.input_tokens, 0) - least(coalesce(payload.usage.cached_input_tokens, 0), coalesce(payload.usage.input_tokens, 0)) AS i, coalesce(payload.usage.output_tokens, 0) AS o, 0::BIGINT AS c, least(coalesce(payload.usage.cached_input_tokens, 0), coalesce(payload.usage.input_tokens, 0)) AS r
  FROM codex_records WHERE try_cast(timestamp AS TIMESTAMPTZ) IS NOT NULL
    QUALIFY nullif(trim(payload.response_id), '') IS NULL OR row_number() OVER (PARTITION BY nullif(trim(payload.response_id), '') ORDER BY record_id) = 1
), source AS (SELECT agent, seq, model, speed, cost_usd, date, i, o, c, r, total FROM claude_rows UNION ALL SELECT *, i + o + c + r FROM codex_rows)"""


@query(f"""WITH {_BOTH}, {_MODELS}, used AS (SELECT *, CASE WHEN agent = 'codex' THEN tokens_cost ELSE cost END AS paid FROM final WHERE total > 0)
SELECT substr(date, 1, 7) AS period, agent, model, sum(total)::BIGINT AS total_tokens, round(sum(paid), 8) AS total_cost, count(*) AS entries,
CASE grouping(substr(date, 1, 7), agent, model) WHEN 7 THEN 0 WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS level FROM used GROUP BY ROLLUP (substr(date, 1, 7), agent, model)""")
def report_unified(s, d):
    from usagemill.functions.lenient import non_empty
    from usagemill.operators.cost import CostPolicy

    codex = dedupe.keep_first(tables.second_agent(table(s, d, "codex_records")), [non_empty(F.col("message_id"))], "seq")
    o = ReportOptions(aliases=ALIASES, tier_tokens=TIER, policies={"codex": CostPolicy("tokens", "tokens")})
    out = reports.unified(messages(s, d).unionByName(codex), price_table(s), "month", o)
    return out.select("period", "agent", "model", "total_tokens", F.round("total_cost", 8).alias("total_cost"), "entries", "level")
