import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from usagemill.functions import dates, lenient, names
from usagemill.operators import blocks, cost, dedupe, ordered, pricing, relate
from usagemill.operators.skew import lag_in_blocks, lookup_join

HOUR = 3_600_000


def brute_blocks(times, length):
    out = []
    for t in sorted(times):
        if not out or t - out[-1][0] > length or t - out[-1][2] > length:
            out.append([t // HOUR * HOUR, t, t, 0])
        out[-1][2] = t
        out[-1][3] += 1
    return sorted(map(tuple, out))


@pytest.mark.parametrize("length", [5 * HOUR, int(2.5 * HOUR), int(0.3 * HOUR)])
def test_blocks_against_the_sequential_rule(spark, length):
    rng = random.Random(length)
    rows = []
    for k in "abc":
        t = rng.randrange(10**9)
        for _ in range(150):
            t += rng.choice([0, 1, 60_000, HOUR // 2, HOUR, 2 * HOUR, length, length + 1])
            if rng.random() < 0.3:
                t = t // HOUR * HOUR
            rows.append((k, t, 1))
    df = spark.createDataFrame(rows, "k string, ts_ms bigint, n bigint")
    got = blocks.blocks(df, ["k"], length, ["n"]).collect()
    for k in "abc":
        assert sorted((r.block_ms, r.first_ms, r.last_ms, r.entries) for r in got if r.k == k) == brute_blocks([t for x, t, _ in rows if x == k], length)


def test_blocks_nulls_empty_and_bad_length(spark):
    df = spark.createDataFrame([(None, 5, 1), (None, None, 1), ("a", 7, None)], "k string, ts_ms bigint, n bigint")
    assert sorted((r.k or "", r.entries, r.n) for r in blocks.blocks(df, ["k"], 5 * HOUR, ["n"]).collect()) == [("", 1, 1), ("a", 1, None)]
    assert blocks.blocks(df.limit(0), ["k"]).count() == 0
    with pytest.raises(ValueError):
        blocks.blocks(df, ["k"], 0)


def test_keep_best_with_null_keys_ties_and_repeats(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 3, 2), ("a", 3, 3), (None, 1, 4), (None, 1, 5)], "k string, v bigint, seq bigint")
    got = sorted(r.seq for r in dedupe.keep_best(df, [F.col("k")], [F.col("v"), -F.col("seq")]).collect())
    assert got == [2, 4, 5] and dedupe.keep_best(df.limit(0), [F.col("k")], [F.col("v")]).count() == 0
    assert sorted(r.seq for r in dedupe.keep_last(df, [F.col("k")], "seq").collect()) == [3, 4, 5]
    twice = df.union(df)
    assert dedupe.keep_first(twice, [F.col("k")], "seq").filter("k = 'a'").count() == 1


def test_copies_in_other_files_go_repeats_stay(spark):
    df = spark.createDataFrame([("f", "x", 1), ("f", "x", 2), ("g", "x", 3), ("g", "y", 4), ("h", None, 5)], "src string, k string, seq bigint")
    assert sorted(r.seq for r in dedupe.across_files(df, ["k"], "src", "seq").collect()) == [1, 2, 4, 5]


def test_likeness_needs_boundaries_and_takes_the_longest(spark):
    price = spark.createDataFrame([("lumen-2",), ("lumen",), ("orbit-4",), ("orbit-4-20250101",), ("ab",)], "model string")
    models = spark.createDataFrame([("vendor/lumen-2-fast",), ("lumen-2.5",), ("lumen-20250102",), ("xlumen-2",), ("orbit-4-20250101",), ("orbit",), ("none",), ("ab",)], "model string")
    got = {r.model: r.key for r in pricing.by_likeness(models, price).collect()}
    assert got == {"vendor/lumen-2-fast": "lumen-2", "lumen-20250102": "lumen", "orbit-4-20250101": "orbit-4-20250101", "ab": "ab"}


def test_resolution_order(spark):
    price = spark.createDataFrame([("a.b",), ("c-d",), ("c@d",), ("e",)], "model string")
    models = spark.createDataFrame([("a.b",), ("a-b",), ("c.d",), ("x",), (None,), ("vendor/e",)], "model string")
    got = {r.model: (r.key, r.how) for r in pricing.resolve(models, price, {"x": "e"}).collect()}
    assert got == {"a.b": ("a.b", "exact"), "a-b": ("a.b", "normal"), "x": ("e", "alias"), "vendor/e": ("e", "like")}


def one(spark, c, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(c.alias("c")).first().c if values else spark.range(1).select(c.alias("c")).first().c


def test_cost_rules(spark):
    lit = F.lit
    assert one(spark, cost.marginal(lit(250), lit(1.0), lit(3.0), 200)) == 350 and one(spark, cost.marginal(lit(250), lit(1.0), lit(None).cast("double"), 200)) == 250
    assert one(spark, cost.whole_request(lit(10), lit(1.0), lit(3.0), lit(201), lit(200))) == 30 and one(spark, cost.whole_request(lit(10), lit(1.0), lit(3.0), lit(200), lit(200))) == 10
    assert one(spark, cost.cache_created(lit(9), lit(2), lit(None).cast("int"))) == 2 and one(spark, cost.cache_created(lit(9), lit(None).cast("int"), lit(None).cast("int"))) == 9
    for total, want in ((20, (12, 0)), (5, (0, 0))):
        o, e = cost.fill_total(lit(0), lit(0), lit(8), lit(total))
        assert (one(spark, o), one(spark, e)) == want
    o, e = cost.fill_total(lit(3), lit(1), lit(8), lit(20))
    assert (one(spark, o), one(spark, e)) == (3, 13)
    assert one(spark, cost.by_mode("display", lit(None).cast("double"), lit(2.0))) == 0 and one(spark, cost.by_mode("auto", lit(1.0), lit(2.0))) == 1
    assert one(spark, cost.surcharge(lit(10.0), {"fast": (lit(4.0), 2.0), "flex": (lit(2.0), 0.5)})) == 13
    with pytest.raises(ValueError):
        cost.by_mode("x", lit(1.0), lit(1.0))


def test_lenient_casts(spark):
    cases = {"5": 5, " 7 ": 7, "+3": 3, "-1": 0, "1.5": 0, "": 0, "x": 0, "9223372036854775807": 9223372036854775807, "9" * 25: 9223372036854775807, "007": 7, None: 0}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.v for r in df.select("t", lenient.lenient_count(F.col("t")).alias("v")).collect()} == cases
    js = spark.createDataFrame([('{"a":5}',), ('{"a":"5"}',), ('{"a":1.5}',), ('{"a":-2}',), ('{"a":null}',), ("broken",)], "t string")
    assert [r.v for r in js.select(lenient.json_count(F.try_variant_get(F.try_parse_json("t"), "$.a", "variant")).alias("v")).collect()] == [5, 0, 0, 0, 0, 0]
    assert one(spark, lenient.parses_strictly(F.lit('{"a":1,"a":2}'))) is False
    arr = one(spark, lenient.sound_elements(F.lit('[{"n":1},{"n":2}]'), "n int"))
    assert [r.n for r in arr] == [1, 2]


def test_dates(spark):
    assert one(spark, dates.week_start(F.lit("2025-01-01"), "sunday")) == "2024-12-29" and one(spark, dates.week_start(F.lit("2025-01-05"), "monday")) == "2024-12-30" and one(spark, dates.week_start(F.lit("odd"))) == "odd"
    assert dates.last_periods(date(2025, 3, 5), "month", 3) == "2025-01-01" and dates.last_periods(date(2025, 1, 5), "week", 1) == "2024-12-30" and dates.last_periods(date(2025, 1, 5), "week", 1, "sunday") == "2025-01-05"
    for t, ok in (("2025-01-01T00:00:00Z", True), ("2025-01-01T00:00:00.123+01:00", True), ("2025-01-01T00:00:00.123456Z", False), ("2025-01-01 00:00:00Z", False), ("2025-02-30T00:00:00Z", False), (None, False)):
        assert (one(spark, dates.strict_ms(F.lit(t).cast("string"))) is not None) == ok
    assert one(spark, dates.rfc3339(F.lit(1735689600005))) == "2025-01-01T00:00:00.005Z"
    assert one(spark, dates.in_instants(F.lit(1743289200000), "2025-03-30", "2025-03-30", "Europe/Berlin")) is True
    assert one(spark, dates.in_instants(F.lit(1743372000000), "2025-03-30", "2025-03-30", "Europe/Berlin")) is False


def test_names(spark):
    assert one(spark, names.without_date(F.lit("m-20250611"))) == "m" and one(spark, names.without_date(F.lit("m-2025-06-11"))) == "m"
    assert one(spark, names.aliased(F.lit("a-fast"), {"a": "b"})) == "b-fast" and names.parse_aliases("a=b, c = d,=x,e") == {"a": "b", "c": "d"}
    assert one(spark, names.session_of(F.lit("projects/p/s1/subagents/x.jsonl"))) == "s1" and one(spark, names.session_of(F.lit("a/s2.jsonl.zst"))) == "s2"
    assert one(spark, names.project_of(F.lit("/x/projects/p/s.jsonl"))) == "p" and one(spark, names.project_of(F.lit("/x/s.jsonl"))) == "unknown"
    assert one(spark, names.decoded(F.lit("a%20b+c%"))) in ("a b+c%", "a%20b+c%") and one(spark, names.project_name(F.lit("-Users-me-app--main"))) == "app"
    assert one(spark, names.dollars(F.lit(2.0))) == "$2.00" and one(spark, names.grouped(F.lit(1234))) == "1,234"


def test_order_operators_on_empty_and_nulls(spark):
    df = spark.createDataFrame([("k", 1, None), ("k", 2, 5), ("k", 3, 4), (None, 1, 9)], "k string, o bigint, v bigint")
    assert [r.delta_v for r in ordered.cumulative_to_delta(df, ["k"], ["o"], ["v"]).filter("k = 'k'").orderBy("o").collect()] == [0, 5, 0]
    assert ordered.carry_forward(df.limit(0), ["k"], ["o"], "v", "c").count() == 0
    assert ordered.last_of(df, ["k"], ["o"], ["v"]).count() == 2


def test_precedence_and_components(spark):
    tier = lambda *rows: spark.createDataFrame(list(rows), "a string, b string, n bigint")
    got = relate.precedence([tier(("t1", "r1", 1)), tier(("t1", None, 2), (None, "r1", 3), ("t2", None, 4)), tier(("t2", "r9", 5), (None, None, 6))], ["a", "b"])
    assert sorted(r.n for r in got.collect()) == [1, 4, 6]
    chain = [(i, f"x{i}") for i in range(40)] + [(i + 1, f"x{i}") for i in range(39)] + [(100, "z"), (101, None)]
    comps = {r.row: r.component for r in relate.shared_identities(spark.createDataFrame(chain, "row bigint, x string"), "row", "x").collect()}
    assert {comps[i] for i in range(40)} == {0} and comps[100] == 100 and 101 not in comps


def test_lookup_join_with_hot_and_null_keys(spark):
    left = spark.createDataFrame([("hot", i) for i in range(300)] + [(f"k{i}", i) for i in range(40)] + [(None, 0)], "k string, n bigint")
    right = spark.createDataFrame([("hot", "H")] + [(f"k{i}", "C") for i in range(0, 40, 2)], "k string, v string")
    want = sorted(map(str, left.join(right, "k", "left").collect()))
    assert sorted(map(str, lookup_join(left, right, "k", hot_rows=50).collect())) == want
    assert lookup_join(left, right, "k", "inner", hot_rows=50).count() == 320


def test_look_back_over_blocks(spark):
    rng = random.Random(1)
    rows = [(k, o, o * 10) for k in "ab" for o in rng.sample(range(500), 60)] + [("c", 3, 30)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    got = {(r.k, r.o): r.prev_v for r in lag_in_blocks(df, ["k"], "o", F.floor(F.col("o") / 50), ["v"]).collect()}
    for k in "abc":
        mine = sorted(o for x, o, _ in rows if x == k)
        assert [got[k, o] for o in mine] == [None] + [o * 10 for o in mine[:-1]]


def test_schedule_keeps_equal_rows(spark):
    from usagemill.operators.pricing import at_time

    usage = spark.createDataFrame([("m", 10, 1), ("m", 10, 1), ("x", 10, 1), (None, 10, 1)], "model string, ts_ms bigint, n int")
    schedule = spark.createDataFrame([("m", None, 20, False, 1.0), ("m", 5, None, False, 2.0)], "model string, from_ms bigint, to_ms bigint, peak boolean, rate double")
    got = sorted((r.model or "", r.rate) for r in at_time(usage, schedule).collect())
    assert got == [("", None), ("m", 2.0), ("m", 2.0), ("x", None)]


def test_tiers_hours_and_extra_tokens(spark):
    from usagemill.operators import cost

    row = "input_tokens bigint, output_tokens bigint, cache_creation_tokens bigint, cache_1h_tokens bigint, cache_read_tokens bigint, extra_total_tokens bigint, speed string"
    usage = spark.createDataFrame([(300_000, 10, 100, 40, 5, 7, None), (100, 10, 100, None, 5, 7, "fast"), (0, 0, 0, 9, 0, 0, None)], row)
    base = {"input_rate": 1.0, "output_rate": 2.0, "cache_create_rate": 3.0, "cache_read_rate": 0.5, "input_above_rate": 2.0, "output_above_rate": 4.0, "cache_create_above_rate": 6.0, "cache_read_above_rate": None, "fast_factor": 3.0}
    for threshold, want in ((None, [200_000 + 200_000 + 20 + 180 + 80 + 2.5, (100 + 20 + 300 + 2.5) * 3, 0.0]), (200_000, [600_000 + 40 + 360 + 160 + 2.5, (100 + 20 + 300 + 2.5) * 3, 0.0])):
        df = usage.select("*", *[F.lit(v).cast("double").alias(k) for k, v in base.items()], F.lit(threshold).cast("bigint").alias("context_threshold"))
        assert [r.c for r in df.select(cost.computed().alias("c")).collect()] == want
    more = usage.select("*", *[F.lit(v).cast("double").alias(k) for k, v in base.items()], F.lit(None).cast("bigint").alias("context_threshold"))
    assert more.select((cost.computed(extra_billed=F.lit(True)) - cost.computed()).alias("c")).first().c == 14.0


def test_cost_policies(spark):
    from usagemill.operators.cost import CostPolicy

    df = spark.createDataFrame([(None, 2.0), (0.0, 2.0), (3.0, 0.0)], "logged double, tokens double")
    pick = lambda p, mode: [r[0] for r in df.select(p.cost(mode, F.col("logged"), F.col("tokens"))).collect()]
    assert pick(CostPolicy(), "auto") == [2.0, 0.0, 3.0] and pick(CostPolicy(auto="positive"), "auto") == [2.0, 2.0, 3.0]
    assert pick(CostPolicy(auto="tokens_first"), "auto") == [2.0, 2.0, 3.0] and pick(CostPolicy(display="zero"), "display") == [0.0, 0.0, 0.0]
    assert pick(CostPolicy(display="tokens"), "display") == pick(CostPolicy(), "calculate") == [2.0, 2.0, 0.0] and pick(CostPolicy(), "display") == [0.0, 0.0, 3.0]


def test_null_keys_are_never_covered(spark):
    from usagemill.operators import relate

    a = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "n int, k string")
    b = spark.createDataFrame([("x",), (None,)], "k string")
    assert sorted(r.n for r in relate.not_counted(a, b, ["k"]).collect()) == [2, 3]
