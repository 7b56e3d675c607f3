import json

from usagemill.cli import arguments, run


def test_daily_from_files(spark, tmp_path):
    folder = tmp_path / "projects/p"
    folder.mkdir(parents=True)
    rows = [{"timestamp": f"2025-01-0{i}T00:00:00Z", "sessionId": "s", "requestId": f"r{i}", "message": {"id": f"msg_{i}", "model": "m", "usage": {"input_tokens": 10 * i, "output_tokens": 1}}} for i in (1, 2)]
    (folder / "a.jsonl").write_text("\n".join(json.dumps(r, separators=(",", ":")) for r in rows))
    (tmp_path / "prices.json").write_text(json.dumps({"model": "m", "input_rate": 0.001, "output_rate": 0.002}))
    base = ["--source", f"claude={tmp_path}", "--prices", str(tmp_path / "prices.json"), "--now", "0"]
    got = run(spark, arguments(["daily", *base])).collect()
    assert [(r.period, r.total_tokens, round(r.total_cost, 6)) for r in got] == [("2025-01-01", 11, 0.012), ("2025-01-02", 21, 0.022)]
    assert run(spark, arguments(["unified", *base, "--no-cost", "--sql", "select count(*) as n from report"])).first().n == 7
    assert [r.seq for r in run(spark, arguments(["session", *base, "--id", "s"])).collect()] == [0, 1]
    assert run(spark, arguments(["blocks", *base, "--token-limit", "15"])).filter("limit_status = 'exceeds'").count() == 1
