import json

import pytest
from pyspark.sql import functions as F

from usagemill.operators.ledger import Ledger
from usagemill.plans import reports
from usagemill.plans.reports import ReportOptions
from usagemill.schema import USAGE, conform, saturating_add, saturating_sum

HOUR = 3_600_000
T = 1735689600000
PRICE = [("m1", 1e-6, 2e-6, None, None, 2.0), ("m2", 1e-5, 1e-5, 1e-5, 1e-6, None)]


def price(spark):
    return spark.createDataFrame(PRICE, "model string, input_rate double, output_rate double, cache_create_rate double, cache_read_rate double, fast_factor double")


def usage(spark, rows):
    names = ["session_id", "project", "message_id", "ts_ms", "model", "input_tokens", "output_tokens", "cost_usd", "seq"]
    df = spark.createDataFrame(rows, "session_id string, project string, message_id string, ts_ms bigint, model string, input_tokens bigint, output_tokens bigint, cost_usd double, seq bigint")
    return conform(df, "a", date=F.lit(None), **{n: F.col(n) for n in names})


ROWS = [
    ("s1", "p1", "a", T, "m1", 100, 10, None, 1), ("s1", "p1", "b", T + HOUR, "m2", 10, 1, 0.5, 2), ("s2", None, "c", T + 26 * HOUR, "m9", 5, 5, None, 3),
    ("s2", "p2", "d", T + 27 * HOUR, None, 7, 7, None, 4), ("s3", "p2", "e", T + 27 * HOUR, "m1", 0, 0, None, 5),
]


def test_daily_report_with_breakdowns(spark):
    rows = reports.periods(usage(spark, ROWS), price(spark), "day").collect()
    assert [(r.period, r.total_tokens, r.entries) for r in rows] == [("2025-01-01", 121, 2), ("2025-01-02", 24, 3)]
    assert abs(rows[0].total_cost - (120e-6 + 0.5)) < 1e-12 and rows[0].models_used == ["m1", "m2"] and [b.model for b in rows[0].model_breakdowns] == ["m2", "m1"]
    assert rows[1].models_used == ["m9", "m1"]
    shown = reports.periods(usage(spark, ROWS), price(spark), "day", ReportOptions(mode="display", order="desc", by_project=True)).collect()
    assert [(r.period, r.project) for r in shown] == [("2025-01-02", "unknown"), ("2025-01-02", "p2"), ("2025-01-01", "p1")] and shown[2].total_cost == 0.5


def test_windows_zones_and_bad_options(spark):
    o = ReportOptions(since="2025-01-02")
    assert [r.period for r in reports.periods(usage(spark, ROWS), price(spark), "day", o).collect()] == ["2025-01-02"]
    assert [r.period for r in reports.periods(usage(spark, ROWS), price(spark), "day", ReportOptions(zone="America/New_York")).collect()] == ["2024-12-31", "2025-01-01"]
    last = ReportOptions(last=1, today="2025-01-02")
    assert [r.period for r in reports.periods(usage(spark, ROWS), price(spark), "day", last).collect()] == ["2025-01-02"]
    assert [r.period for r in reports.periods(usage(spark, ROWS), price(spark), "week", ReportOptions()).collect()] == ["2024-12-29"]
    for bad in ({"last": 1, "since": "2025-01-01"}, {"since": "2025-13-01"}, {"since": "x"}, {"mode": "x"}):
        with pytest.raises(ValueError):
            ReportOptions(**bad)


def test_sessions_totals_and_json(spark):
    found = reports.sessions(usage(spark, ROWS), price(spark))
    assert [r.session_id for r in found.collect()] == ["s1", "s2"]
    t = reports.totals(found).first()
    assert t.total_tokens == 145 and t.credits is None
    assert json.loads(reports.as_json(found).first().json)["session_id"] == "s1"
    daily = reports.periods(usage(spark, ROWS), price(spark), "day", ReportOptions(by_project=True))
    assert {r.project for r in reports.by_project_json(daily).collect()} == {"p1", "p2", "unknown"}
    bare = reports.without_cost(daily)
    assert "total_cost" not in bare.columns and "total_cost" not in bare.first().model_breakdowns[0].asDict()
    assert reports.select_sql(daily, "select max(period) as p from report").first().p == "2025-01-02"
    assert [r.seq for r in reports.session(usage(spark, ROWS), price(spark), "s2").collect()] == [3, 4]


def test_blocks_report_and_statusline(spark):
    now = T + 27 * HOUR + 60_000
    o = ReportOptions(now_ms=now, token_limit="max")
    rows = reports.billing_blocks(usage(spark, ROWS), price(spark), o).collect()
    assert [(r.block_ms, r.tokens, r.active) for r in rows] == [(T, 121, False), (T + 26 * HOUR, 24, True)]
    assert rows[0].token_limit == 121 and rows[1].limit_status is not None
    assert [r.tokens for r in reports.billing_blocks(usage(spark, ROWS), price(spark), ReportOptions(now_ms=now, active=True)).collect()] == [24]
    line = reports.statusline(usage(spark, ROWS), price(spark), "s1", ReportOptions(now_ms=now)).first()
    assert abs(line.session_cost - 0.50012) < 1e-9 and line.context_tokens == 10 and line.block_end_ms == T + 31 * HOUR


def test_unified_levels(spark):
    got = reports.unified(usage(spark, ROWS), price(spark), "day").collect()
    assert [r.total_tokens for r in got if r.level == 0] == [145] and sum(r.total_tokens for r in got if r.level == 2) == 145


def test_empty_usage(spark):
    none = usage(spark, [])
    assert none.columns == list(USAGE)
    for df in (reports.periods(none, price(spark), "month"), reports.sessions(none, price(spark)), reports.billing_blocks(none, price(spark))):
        assert df.count() == 0


def test_saturation(spark):
    top = 9223372036854775807
    df = spark.createDataFrame([(top, 1), (5, 2)], "a bigint, b bigint")
    assert df.select(saturating_add(F.col("a"), F.col("b")).alias("s")).first().s == top
    assert df.agg(saturating_sum("a").alias("s")).first().s == top


def test_ledger_outlives_its_source(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    ledger.append("n", usage(spark, ROWS[:3]))
    ledger.append("n", usage(spark, ROWS[1:]))
    assert ledger.read("n").count() == 5
    live = usage(spark, ROWS[:1])
    assert ledger.merged("n", live).count() == 5 and ledger.merged("n", live, live_only=True).count() == 1
    changed = usage(spark, [(*ROWS[0][:7], 9.0, 1)])
    ledger.append("n", changed)
    assert ledger.read("n").filter("message_id = 'a'").first().cost_usd is None
    twice = usage(spark, [(None, None, None, T, "m1", 1, 1, None, 1), (None, None, None, T, "m1", 1, 1, None, 2), (None, None, "", T, "m2", 1, 1, None, 3)])
    ledger.append("other", twice)
    assert ledger.read("other").count() == 2
    ledger.clear("n")
    assert ledger.read("n") is None and ledger.read("other").count() == 2
    ledger.clear()
    assert ledger.read("other") is None


def test_flags_envelope_and_no_cost(spark):
    u, p = usage(spark, ROWS), price(spark)
    daily = reports.periods(u, p, "day")
    rows = daily.collect()
    assert [(r.missing_price, r.stored_cost) for r in rows] == [(False, 0.5), (True, 0.0)]
    doc = json.loads(reports.envelope(daily, "daily", reports.priced(u, p, ReportOptions())).first().json)
    assert [r["period"] for r in doc["daily"]] == ["2025-01-01", "2025-01-02"] and doc["totals"]["unpriced_models"] == ["m9"]
    bare = reports.periods(u, p, "day", ReportOptions(with_cost=False))
    assert "cost" not in json.dumps(bare.schema.jsonValue())


def test_sessions_of_some_agents_are_kept_per_project(spark):
    u = usage(spark, ROWS).withColumn("project", F.when(F.col("message_id") == "b", "p9").otherwise(F.col("project")))
    assert [(r.session_id, r.session_project) for r in reports.sessions(u, price(spark), ReportOptions(project_sessions=("a",))).orderBy("session_id", "session_project").collect()] == [("s1", "p1"), ("s1", "p9"), ("s2", None), ("s2", "p2")]
    both = reports.sections(u, price(spark), ["day", "session"])
    assert both["day"].count() == 2 and both["session"].count() == 2
