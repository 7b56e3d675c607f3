import json
import os

from usagemill.config import layered, load
from usagemill.sources.prices import catalogue, feed
from usagemill.streaming.changed import fingerprint, gone, listing, refreshed, stale


def test_feeds_in_both_spellings(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"m1": {"input_cost_per_token": 1e-6, "output_cost_per_token": 2e-6, "max_input_tokens": 5, "provider_specific_entry": {"fast": 2}}, "m2": {"i": 3e-6, "o": 4e-6, "cra": 1e-7}, "none": {"mode": "chat"}, "odd": 5}))
    (tmp_path / "b.json").write_text(json.dumps({"m1": {"i": 9.0}}))
    got = {r.model: r for r in feed(spark, str(tmp_path)).collect()}
    assert set(got) == {"m1", "m2"} and got["m1"].input_rate == 1e-6 and got["m1"].fast_factor == 2 and got["m1"].context_limit == 5 and got["m2"].cache_read_above == 1e-7


def test_catalogue_prefers_trusted_then_fuller(spark, tmp_path):
    entry = lambda x, **kw: {"cost": {"input": x, "output": x, **kw}}
    (tmp_path / "c.json").write_text(json.dumps({"p": {"models": {"m": entry(1), "n": entry(2)}}, "q": {"models": {"m": entry(3), "n": entry(4, cache_read=1), "x": {"id": "k", "cost": {"input": 5, "output": 6}}}}}))
    got = {r.model: r.input_rate for r in catalogue(spark, str(tmp_path), ["q"]).collect()}
    assert got == {"m": 3e-6, "n": 4e-6, "k": 5e-6}
    assert {r.model: r.input_rate for r in catalogue(spark, str(tmp_path)).collect()} == {"m": 1e-6, "n": 4e-6, "k": 5e-6}


def test_layers(tmp_path):
    doc = {"defaults": {"mode": "auto", "order": "asc", "zone": None}, "commands": {"daily": {"order": "desc"}}, "agents": {"a": {"defaults": {"mode": "display"}, "commands": {"daily": {"last": 3}}}}}
    assert layered(doc, "daily", "a") == {"mode": "display", "order": "desc", "last": 3} and layered(doc, "weekly") == {"mode": "auto", "order": "asc"}
    (tmp_path / "1.json").write_text(json.dumps(doc))
    (tmp_path / "2.json").write_text(json.dumps({"defaults": {"mode": "calculate"}}))
    both = load(str(tmp_path / "1.json"), str(tmp_path / "absent.json"), str(tmp_path / "2.json"))
    assert layered(both, "daily")["mode"] == "calculate" and layered(both, "daily")["order"] == "desc"


def test_changed_files_and_fingerprints(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.jsonl").write_text("{}")
    known = spark.createDataFrame(listing(spark, str(tmp_path), "*.jsonl").collect(), "src_file string, modified_at timestamp, size bigint")
    (tmp_path / "b.jsonl").write_text("{}{}")
    os.remove(tmp_path / "c.jsonl")
    (tmp_path / "d.jsonl").write_text("{}")
    now = listing(spark, str(tmp_path), "*.jsonl")
    last = lambda df: sorted(r.src_file[-7:] for r in df.collect())
    assert last(stale(now, known)) == ["b.jsonl", "d.jsonl"] and last(gone(now, known)) == ["c.jsonl"]
    parsed = known.select("src_file").selectExpr("src_file", "1 as n")
    fresh = stale(now, known).selectExpr("src_file", "2 as n")
    assert sorted((r.src_file[-7:], r.n) for r in refreshed(parsed, fresh, now, known).collect()) == [("a.jsonl", 1), ("b.jsonl", 2), ("d.jsonl", 2)]
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "x int, y string")
    assert fingerprint(df).first() == fingerprint(df.orderBy("x", ascending=False)).first() != fingerprint(df.distinct()).first()
