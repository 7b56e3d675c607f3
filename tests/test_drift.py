import itertools
import json
import random

from pyspark.sql import functions as F

from usagemill.operators.drift import best_matching, changes, columns_by_links, columns_of, matches, narrowed, path_of, profiles, renames, unified, unified_by_matches, versions
from usagemill.plans.data_queries import PATHS, SEEDS, TRACKED, p6_changes, p6_found

SCHEMA = "line_id bigint, stream string, file_seq int, src_file string, line_no int, raw string, path string"


def lines(spark, files):
    rows, k = [], itertools.count()
    for (stream, seq), raws in files.items():
        for n, raw in enumerate(raws):
            rows.append((next(k), stream, seq, f"{stream}/{seq}", n, raw, "clash"))
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def run(spark, files, **kw):
    got = changes(lines(spark, files), "stream", "file_seq", "src_file", "raw", TRACKED, **kw).collect()
    return sorted((r.src_file, r.change, r.old_path, r.new_path) for r in got)


FILES = {
    ("a", 1): ['{"payload":{"model":"x"}}', '{"payload":{"model":null}}'],
    ("a", 2): ['{"payload":{"model_name":"x"}}', "broken"],
    ("a", 5): ['{"payload":{"\\u006dodel_name":7}}'],
    ("a", 600): ['{"payload":{"model_name":7,"info":{"model":["y"]}}}', '{"message":{"usage":{"speed":true}}}'],
    ("a", 601): ['{"payload.model":"no","message":{"model":"z"}}'],
    ("a", 602): ["[]", "3"],
    ("a", 603): ['{"payload":{"info":{"model":{"id":"q"}}}}', '{"payload":{"info":{"model":{"id":"q"}}}}'],
    ("b", 1): ['{"payload":{"model":"x"}}'],
}


def test_changes(spark):
    s = "message.usage.speed"
    assert run(spark, FILES) == sorted([
        ("a/2", "renamed", "payload.model", "payload.model_name"), ("a/5", "retyped", "payload.model_name", "payload.model_name"),
        ("a/600", "added", "", "payload.info.model"), ("a/600", "added", "", s),
        ("a/601", "removed", "payload.model_name", ""), ("a/601", "removed", "payload.info.model", ""), ("a/601", "removed", s, ""),
        ("a/603", "added", "", "payload.info.model"),
    ])


def test_matching_prefers_like_names_types_and_values(spark):
    files = {("m", 1): [json.dumps({"payload": {"model": f"v{i}", "info": {"model": i}}}) for i in range(20)], ("m", 2): [json.dumps({"payload": {"model_name": f"v{i}"}, "message": {"usage": {"speed": i}}}) for i in range(20)]}
    df = lines(spark, files)
    got = {(r.old_path, r.new_path): r.score for r in matches(versions(profiles(df, "stream", "file_seq", "src_file", "raw", TRACKED))).collect()}
    assert set(got) == {("payload.model", "payload.model_name"), ("payload.info.model", "message.usage.speed")}
    assert got["payload.model", "payload.model_name"] > 0.7
    free = run(spark, files, sole=False, min_score=0.5)
    assert ("m/2", "renamed", "payload.model", "payload.model_name") in free
    assert {c[1] for c in run(spark, files)} == {"added", "removed"}


def test_hungarian_against_all_permutations():
    rng = random.Random(5)
    for n, m in ((1, 1), (2, 4), (4, 2), (4, 4), (3, 5)):
        w = [[rng.random() for _ in range(m)] for _ in range(n)]
        best = max(sum(w[i][j] for i, j in zip(range(n), p)) for p in itertools.permutations(range(m), n)) if n <= m else max(sum(w[i][j] for j, i in zip(range(m), p)) for p in itertools.permutations(range(n), m))
        pairs = best_matching(w)
        assert len(pairs) == min(n, m) and abs(sum(w[i][j] for i, j in pairs) - best) < 1e-9


UNIFIED = {"model": PATHS[:4], "speed": PATHS[4:]}


def test_columns_follow_links_and_stay_apart():
    found = [("payload.model", "payload.model_name", 9, 0.8), ("payload.info.model", "payload.model_name", 5, 0.7), ("message.usage.speed", "payload.model_name", 1, 0.5)]
    assert columns_by_links(SEEDS, PATHS, found) == UNIFIED
    assert columns_by_links(SEEDS, PATHS, found[:1]) == {"model": ["payload.model", "message.model", "payload.model_name"], "speed": ["message.usage.speed"]}
    assert columns_by_links(SEEDS, PATHS, [("payload.info.model", "payload.model_name", 2, 0.6)])["model"] == ["payload.model", "message.model"]


def test_unified_by_what_was_renamed(spark):
    names = [f"m-{i}" for i in range(5)]
    files = {("s", 1): [json.dumps({"payload": {"model": x}}) for x in names], ("s", 2): [json.dumps({"payload": {"model_name": x}}) for x in names], ("s", 3): [json.dumps({"payload": {"info": {"model": [x]}}}) for x in names]}
    files |= {("t", 1): [json.dumps({"payload": {"info": {"model": x}}}) for x in names], ("t", 2): [json.dumps({"payload": {"model_name": x}, "message": {"usage": {"speed": True}}}) for x in names]}
    df = lines(spark, files)
    got = unified_by_matches(df, "stream", "file_seq", "src_file", "raw", SEEDS, PATHS, ["src_file", "line_no"]).collect()
    assert len(got) == 25 and all(r.model == f"m-{r.line_no}" for r in got) and {r.speed for r in got if r.src_file == "t/2"} == {"true"}
    found = renames(versions(profiles(df, "stream", "file_seq", "src_file", "raw", TRACKED))).collect()
    assert {(r.src_file, r.old_path, r.new_path) for r in found} == {("s/2", "payload.model", "payload.model_name"), ("t/2", "payload.info.model", "payload.model_name")}
    assert unified_by_matches(lines(spark, {}), "stream", "file_seq", "src_file", "raw", SEEDS, PATHS, ["line_id"]).count() == 0


def test_unified(spark):
    rows = {r.src_file + str(r.line_no): (r.model, r.speed) for r in unified(lines(spark, FILES), "raw", UNIFIED, ["src_file", "line_no"]).collect()}
    assert rows["a/10"] == ("x", None) and rows["a/20"] == ("x", None) and rows["a/50"] == ("7", None) and rows["a/6001"] == (None, "true")
    assert rows["a/6010"] == ("z", None) and rows["a/6030"] == ("q", None) and rows["a/21"] == (None, None)


def test_empty(spark):
    assert run(spark, {}) == []


def whole(spark, files, **kw):
    got = changes(lines(spark, files), "stream", "file_seq", "src_file", "raw", None, **{"min_score": 0.5, "sole": False} | kw).collect()
    return sorted((r.src_file, r.change, r.old_path, r.new_path) for r in got)


def _objects(n, make):
    return [json.dumps(make(i)) for i in range(n)]


WIDE = {
    ("w", 1): _objects(9, lambda i: {"at": i, "payload": {"model": {"id": f"m{i}", "by": f"b{i % 3}"}, "usage": {"input_tokens": 100 + i}}}),
    ("w", 3): _objects(9, lambda i: {"at": i, "payload": {"info": {"model": {"id": f"m{i}", "by": f"b{i % 3}"}}, "usage": {"inputTokens": 100 + i}, "text": True}}),
    ("w", 4): _objects(9, lambda i: {"at": str(i), "payload": {"info": {"model": {"id": f"m{i}", "by": f"b{i % 3}"}}, "usage": {"inputTokens": 100 + i}, "text": True}}),
}


def test_every_column_is_matched(spark, tmp_path):
    pairs = [("payload.model", "payload.info.model"), ("payload.model.id", "payload.info.model.id"), ("payload.model.by", "payload.info.model.by"), ("payload.usage.input_tokens", "payload.usage.inputTokens")]
    want = sorted([("w/3", "renamed", a, b) for a, b in pairs] + [("w/3", "added", "", "payload.info"), ("w/3", "added", "", "payload.text"), ("w/4", "retyped", "at", "at")])
    assert whole(spark, WIDE) == want
    lines(spark, WIDE).write.parquet(f"{tmp_path}/log_lines.parquet")
    assert sorted((r.src_file, r.change, r.old_path, r.new_path) for r in p6_changes(spark, str(tmp_path)).collect()) == want
    assert [tuple(r) for r in p6_found(spark, str(tmp_path)).collect()] == [("w/3", "renamed", "payload.model", "payload.info.model")]


def test_tracked_part_of_the_whole_report(spark):
    rng = random.Random(3)
    values = [1, "x", "y", True, [2], {"id": "q"}, {"id": 7, "mode": {"model": "z"}}, None]
    pick = lambda: {k: rng.choice(values) for k in ("model", "model_name", "other") if rng.random() < 0.5} | ({"info": rng.choice([{"model": rng.choice(values)}, 3, [{"model": 1}]])} if rng.random() < 0.6 else {})
    files = {("r", n): _objects(2, lambda i: {"payload": pick(), "message": {"usage": {"speed": rng.choice(values)}}}) for n in range(60)}
    for some in (FILES | WIDE, files, {}):
        df = lines(spark, some)
        report = changes(df, "stream", "file_seq", "src_file", "raw", None, min_score=0.5, sole=False)
        assert sorted(tuple(r) for r in narrowed(report, TRACKED).collect()) == run(spark, some)


def test_odd_keys_are_columns_of_their_own(spark):
    odd = {"a.b": 1, "a": {"b": 2, "": {}}, "c d": {"e": None, "`x`": [1, {"y": 2}], "it's \"q\"": 1.5}, "n,:<>": {"ä\n\\": "t"}, "OBJECT": False}
    shape = spark.range(1).select(F.schema_of_variant(F.parse_json(F.lit(json.dumps(odd))))).first()[0]
    got = dict(zip(*columns_of(shape)))
    want = {("a.b",): "number", ("a",): "object", ("a", "b"): "number", ("a", ""): "object", ("c d",): "object", ("c d", "`x`"): "array", ("c d", "it's \"q\""): "number", ("n,:<>",): "object", ("n,:<>", "ä\n\\"): "string", ("OBJECT",): "boolean"}
    assert got == {path_of(k): t for k, t in want.items()} and len(got) == 10
    keys = ["a.b", "it's \"q\"", "", "`x`", "ä\n\\", "[0]", "$"]
    files = {("k", 1): _objects(8, lambda i: {"in": {k: f"{k}{i}" for k in keys}}), ("k", 2): _objects(8, lambda i: {"in": {k + "2": f"{k}{i}" for k in keys}})}
    assert whole(spark, files) == sorted(("k/2", "renamed", path_of(["in", k]), path_of(["in", k + "2"])) for k in keys)


def test_a_file_of_many_columns(spark):
    n, deep = 150, "1"
    old, new = _objects(4, lambda i: {f"old{k}": f"{k}-{i}" for k in range(n)}), _objects(4, lambda i: {f"x_{k * 7 % n}": f"{k * 7 % n}-{i}" for k in range(n)})
    for _ in range(400):
        deep = f'{{"d":{deep}}}'
    want = [("m/2", "renamed", f"old{k}", f"x_{k}") for k in range(n)] + [("m/3", "added", "", ".".join("d" * (k + 1))) for k in range(400)]
    assert whole(spark, {("m", 1): old, ("m", 2): new, ("m", 3): [*new, deep]}) == sorted(want)
