import random

from pyspark.sql import functions as F

from usagemill.operators.sessions import SessionTable, instant_ms, local_sessions, sessionise, with_gap

SCHEMA = "batch_id int, session_id string, project string, time_ms bigint, gap_ms bigint"


def brute(rows):
    keyed = {}
    for _, s, p, t, g in rows:
        keyed.setdefault((s, p), []).append((t, g))
    out = []
    for (s, p), ts in keyed.items():
        ts.sort()
        cur = None
        for t, g in ts:
            if cur is None or t - cur[1] > max(g, 0):
                cur = [t, t, 0]
                out.append((s, p, cur))
            cur[1], cur[2] = t, cur[2] + 1
    return sorted((s, p, *c) for s, p, c in out)


def found(table):
    return sorted((r.session_id, r.project, r.start_ms, r.end_ms, r.event_count) for r in table.read().collect())


def random_rows(seed, n=400, gap=100):
    rng = random.Random(seed)
    return [(rng.randrange(6), f"s{min(3, int(rng.expovariate(1)))}", f"p{rng.randrange(2)}", rng.randrange(-3000, 9000), gap) for _ in range(n)]


def test_events_without_a_batch_count(spark):
    rows = random_rows(3)
    some = [(None if i % 3 == 0 else r[0], *r[1:]) for i, r in enumerate(rows)]
    none = [(None, *r[1:]) for r in rows]
    for given in (some, none, []):
        assert found(sessionise(spark.createDataFrame(given, SCHEMA), ["session_id", "project"], "batch_id", 3)) == brute(given)


def test_increments_give_what_one_pass_gives(spark):
    for seed in (1, 2):
        rows = random_rows(seed)
        df = spark.createDataFrame(rows, SCHEMA)
        assert found(sessionise(df, ["session_id", "project"], "batch_id", 3)) == brute(rows)


def test_gap_edges_ties_and_bridges(spark):
    rows = [(0, "a", "p", 0, 10), (0, "a", "p", 0, 10), (0, "a", "p", 10, 10), (0, "a", "p", 21, 10), (1, "a", "p", 15, 10), (0, "b", "p", 0, 0), (0, "b", "p", 0, 0), (0, "b", "p", 1, 0)]
    assert found(sessionise(spark.createDataFrame(rows, SCHEMA), ["session_id", "project"], "batch_id", 2)) == brute(rows)


def test_versions_are_atomic_and_can_be_reopened(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    first = SessionTable(spark, ["session_id", "project"], path, 4)
    a, b = random_rows(5, 60), random_rows(6, 60)
    local = lambda rows: local_sessions(spark.createDataFrame(rows, SCHEMA), ["session_id", "project"], "time_ms", "gap_ms")
    first.apply(local(a))
    old = first.read()
    again = SessionTable(spark, ["session_id", "project"], path, 4)
    again.apply(local(b))
    assert sorted(map(tuple, old.collect())) == sorted(map(tuple, first.read().collect()))
    assert found(again) == brute(a + b)
    before, reader = sorted(map(tuple, again.read().collect())), again.read()
    again.apply(local(random_rows(7, 30)))
    again.vacuum()
    assert sorted(map(tuple, reader.collect())) == before  # a reader of the former version isn't disturbed
    again.vacuum(0)
    assert found(SessionTable(spark, ["session_id", "project"], path, 4)) == brute(a + b + random_rows(7, 30))


def test_a_table_keeps_its_buckets_and_keys(spark, tmp_path):
    path, keys = f"file://{tmp_path}/t", ["session_id", "project"]
    local = lambda rows: local_sessions(spark.createDataFrame(rows, SCHEMA), keys, "time_ms", "gap_ms")
    rows = [(0, f"s{i}", "p", 0, 100) for i in range(40)]
    SessionTable(spark, keys, path, 8).apply(local(rows))
    again = SessionTable(spark, keys, path)
    later = [(0, s, p, 50, g) for _, s, p, _, g in rows]
    again.apply(local(later))
    assert again.buckets == 8 and found(again) == brute(rows + later)
    again.rebucket(3)
    last = SessionTable(spark, keys, path, 64)
    last.apply(local(later))
    assert last.buckets == 3 and found(last) == brute(rows + later + later)
    try:
        SessionTable(spark, ["project"], path)
        raise AssertionError
    except ValueError:
        pass


def test_a_batch_reads_only_the_spans_it_can_reach(spark, tmp_path, monkeypatch):
    keys = ["session_id", "project"]
    table = SessionTable(spark, keys, f"file://{tmp_path}/t", 2, span_ms=1000)
    local = lambda rows: local_sessions(spark.createDataFrame(rows, SCHEMA), keys, "time_ms", "gap_ms")
    a = random_rows(9, 200)
    table.apply(local(a))
    asked, real = [], SessionTable.read
    monkeypatch.setattr(SessionTable, "read", lambda self, parts=None: asked.append(parts) or real(self, parts))
    b = [(0, "s0", "p0", 8950, 100), (0, "s1", "p1", 20_000, 100)]
    table.apply(local(b))
    assert asked and min(s for _, s in asked[0]) >= 8
    assert found(table) == brute(a + b)


def test_half_a_manifest_is_never_read(spark, tmp_path):
    keys, path = ["session_id", "project"], f"{tmp_path}/t"
    table = SessionTable(spark, keys, f"file://{path}", 2)
    a = random_rows(10, 50)
    table.apply(local_sessions(spark.createDataFrame(a, SCHEMA), keys, "time_ms", "gap_ms"))
    with open(f"{path}/_manifest/draft-0", "w") as f:
        f.write('{"keys"')
    assert found(SessionTable(spark, keys, f"file://{path}", 2)) == brute(a)


def test_empty(spark):
    table = sessionise(spark.createDataFrame([], SCHEMA), ["session_id", "project"], "batch_id")
    assert table.read().count() == 0
    table.apply(table.read())
    assert table.version == 0


def test_gap_of_project_star_and_default(spark):
    events = spark.createDataFrame([("a",), ("b",), (None,)], "project string")
    config = spark.createDataFrame([("a", 0.5), ("b", None), ("*", 2.0)], "project string, hours double")
    got = {r.project: r.gap_ms for r in with_gap(events, config, "project").collect()}
    assert got == {"a": 1_800_000, "b": 7_200_000, None: 7_200_000}
    assert with_gap(events, config.filter("project = 'a'"), "project", 99).agg(F.max("gap_ms"), F.min("gap_ms")).first()[1] == 99


def test_instants(spark):
    cases = {
        "2025-01-01T00:00:00Z": 1735689600000, "2025-01-01T02:00:00.5+02:00": 1735689600500, "2025-01-01T00:00:00.123999-0030": 1735691400123, "2025-01-01T00:00Z": 1735689600000,
        "2025-02-30T00:00:00Z": None, "2025-01-01T24:00:00Z": None, "2025-01-01T00:60:00Z": None, "2025-01-01T00:00:00": None, "2025-01-01 00:00:00Z": None, "25:61:00": None, "n/a": None, "": None,
        "2025-01-01T00:00:00+25:00": None, "1969-12-31T23:59:59.999Z": -1,
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r.t: r.ms for r in df.select("t", instant_ms(F.col("t")).alias("ms")).collect()}
    assert got == cases | {None: None}
