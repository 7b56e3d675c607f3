import random

from pyspark.sql import functions as F

from usagemill.operators.delivery import SeenMessages, first_copies, identify, merge_ranges, number_ranges, response_identity, sequence, superfluous, superfluous_seen, usage_identity, usage_scope
from usagemill.plans.data_queries import QUERIES

SCHEMA = "record_id bigint, requestId string, sessionId string, message struct<id string>, keep_id string"


def usage(spark, rows):
    return spark.createDataFrame([(i, r, s, (m,), "clash") for i, (m, r, s) in enumerate(rows)], SCHEMA)


def brute(rows):
    first, out = {}, set()
    for i, (m, r, s) in enumerate(rows):
        m, r, s = ((x or "").strip(" ") for x in (m, r, s))
        key = (m, "r" + r) if r else (m, "s" + s) if s else None
        if m and key:
            if key in first:
                out.add((first[key], i))
            first.setdefault(key, i)
    return out


def test_identity_rules(spark):
    h = "0123456789abcdef"
    rows = [
        (f"msg_{h}", "r1", "s1"), (f"msg_{h} ", " r1", "s2"), (f"msg_{h}", "r2", "s1"), (f"msg_{h}", None, "s1"), (f"msg_{h}", " ", "s1"), (f"msg_{h}", "", "s2"), (f"MSG_{h}", "r1", "s1"),
        (f"msg_{h.upper()}", "r1", "s1"), (None, "r1", "s1"), (" ", "r1", "s1"), (f"msg_{h}", None, None), (f"msg_{h}", "", " "), ("plain", "r1", "s1"), ("plain", "r1", "s1"),
        ("m-7", "r", "s"), ("m-07", "r", "s"), ("m-7", "r", "s"), ("m-7 ", "r", "s"), ("7", "r", "s"), ("7", "r", "s"), ("x" * 100_000, "r", "s"), ("x" * 100_000, "r", "s"),
    ]
    got = {(r.keep_id, r.drop_id) for r in superfluous(usage_identity(usage(spark, rows))).collect()}
    assert got == brute(rows)


def test_random_with_a_hot_message(spark):
    rng = random.Random(1)
    rows = [(f"msg_{rng.randrange(30):016x}" if rng.random() < 0.6 else "msg_00000000000000aa", rng.choice(["a", "b", None]), rng.choice(["s", "t"])) for _ in range(500)]
    assert {(r.keep_id, r.drop_id) for r in superfluous(usage_identity(usage(spark, rows))).collect()} == brute(rows)


def test_sequence_forms_give_back_the_identifier(spark):
    ids = ["msg_00000000000000ff", "msg_ffffffffffffffff", "m-12", "m-012", "m", "12", "a-999999999999999999", "a-9999999999999999999", "resp_c7423cafa8ffda80-1"]
    producer, number = sequence(F.col("i"))
    got = spark.createDataFrame([(i,) for i in ids], "i string").select("i", producer.alias("p"), number.alias("n")).collect()
    assert len({(r.p, r.n) for r in got}) == len(ids)
    assert [r.n for r in got][:6] == [255, -1, 12, None, None, None]


def ranges_of(numbers):
    out = []
    for n in sorted(set(numbers)):
        if out and out[-1][1] == n - 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return sorted(map(tuple, out))


def test_ranges_merge_over_block_edges(spark):
    rng = random.Random(2)
    numbers = [rng.randrange(-60, 90) for _ in range(120)] + list(range(200, 340))
    df = spark.createDataFrame([("p", n) for n in numbers], "k string, n bigint")
    assert sorted((r.lo, r.hi) for r in number_ranges(df, ["k"], "n").collect()) == ranges_of(numbers)
    wide = spark.createDataFrame([("p", 0, 70), ("p", 71, 75), ("p", 60, 100), ("p", 102, 102), ("q", 5, 4)], "k string, lo bigint, hi bigint")
    for block in (8, 64, 65536):
        assert sorted((r.k, r.lo, r.hi) for r in merge_ranges(wide, ["k"], block).collect()) == [("p", 0, 100), ("p", 102, 102)]


def test_seen_messages_accept_each_once(spark, tmp_path):
    rng = random.Random(4)
    seen = SeenMessages(spark, f"file://{tmp_path}/seen")
    accepted, order = set(), 0
    for _ in range(3):
        rows = [(f"p{rng.randrange(2)}-{rng.randrange(60)}" if rng.random() < 0.7 else rng.choice(["odd", "p0-007", "ü"]), order + i) for i in range(80)]
        order += 80
        df = spark.createDataFrame(rows, "i string, o bigint")
        got = seen.accept(identify(df, F.col("i"), F.lit(""), F.col("o"))).collect()
        by_order = {o: i for i, o in rows}
        fresh = {by_order[r.order_id] for r in got}
        assert len(fresh) == len(got) and not fresh & accepted
        assert fresh | accepted == accepted | {i for i, _ in rows}
        accepted |= fresh
        seen = SeenMessages(spark, f"file://{tmp_path}/seen")
    spans = [(r.producer, r.lo, r.hi) for r in seen.ranges().collect()]
    for p in {s[0] for s in spans}:
        mine = sorted(s[1:] for s in spans if s[0] == p)
        assert all(a[1] + 1 < b[0] for a, b in zip(mine, mine[1:]))


def test_long_runs_stay_short_and_deltas_merge(spark, tmp_path):
    """Numbers in mixed order over several levels of blocks, with folders merged on the way."""
    rng = random.Random(6)
    numbers = [*range(-700, 70_000), *range(2**40, 2**40 + 300, 2), -(2**63), 2**63 - 1]
    rng.shuffle(numbers)
    parts = [numbers[i::4] for i in range(4)]
    for most in (2, 16):
        seen = SeenMessages(spark, f"file://{tmp_path}/seen{most}", most)
        for part in parts:
            df = spark.createDataFrame([("p", n, "", i) for i, n in enumerate(part)], "producer string, number bigint, scope string, order_id bigint")
            assert seen.accept(df).count() == len(part)
        again = spark.createDataFrame([("p", n, "", 0) for n in numbers[:500]] + [("p", 70_000, "", 1), ("q", 5, "", 2), ("p", 2**40 + 1, "", 3)], "producer string, number bigint, scope string, order_id bigint")
        assert {(r.producer, r.number) for r in seen.uncovered(again).collect()} == {("p", 70_000), ("q", 5), ("p", 2**40 + 1)}
        assert len(seen.folders) == (2 if most == 2 else 4)
        seen.compact()
        assert len(seen.folders) == 1 and seen.pieces().count() < 200 and max(seen.levels) == 2
        spans = sorted((r.lo, r.hi) for r in seen.ranges().collect())
        assert spans[1] == (-700, 69_999) and len(spans) == 153


def test_first_copies_are_what_superfluous_leaves(spark):
    rng = random.Random(7)
    rows = [(rng.choice([f"m-{rng.randrange(9)}", "odd", None, " "]), rng.choice(["a", None]), rng.choice(["s", "t", None])) for _ in range(200)]
    df = usage(spark, rows)
    kept = {r.record_id for r in first_copies(df, F.col("message.id"), usage_scope(), "record_id").collect()}
    assert kept == set(range(200)) - {d for _, d in brute(rows)}


def test_found_by_what_was_seen(spark, data, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice([f"msg_{rng.randrange(20):016x}", f"m-{rng.randrange(9)}", "odd", None]), rng.choice(["a", None]), rng.choice(["s", "t"])) for _ in range(300)]
    for given in (rows, rows[:2], []):
        assert sorted((r.keep_id, r.drop_id) for r in superfluous_seen(usage_identity(usage(spark, given))).collect()) == sorted(brute(given))
    real, calls = SeenMessages.accept, []
    monkeypatch.setattr(SeenMessages, "accept", lambda self, df: calls.append(1) or real(self, df))
    got = {(r.keep_id, r.drop_id) for r in QUERIES["p5_found"](spark, data).filter("table_name = 'claude_usage'").collect()}
    plain = superfluous(usage_identity(spark.read.parquet(f"{data}/claude_usage.parquet")))
    assert got == {(r.keep_id, r.drop_id) for r in plain.collect()} and len(calls) == 6


def test_empty(spark):
    assert superfluous(usage_identity(usage(spark, []))).count() == 0
    codex = spark.createDataFrame([], "record_id bigint, payload struct<response_id string>")
    assert superfluous(response_identity(codex)).count() == 0
