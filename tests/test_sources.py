import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from usagemill.sources import agents, wire
from usagemill.sources.agents import READERS
from usagemill.sources.sqlite import read_table
from usagemill.sources.text import lines

FIELDS = ("session_id", "message_id", "ts_ms", "model", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "extra_total_tokens", "cost_usd")
T = 1735689600000


def put(root, name, *rows):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, separators=(",", ":")) for r in rows) + "\n")


def db(root, name, *statements):
    (root / name).parent.mkdir(parents=True, exist_ok=True)
    con = sqlite3.connect(root / name)
    for sql, *values in statements:
        con.execute(sql, values)
    con.commit()
    con.close()


def run(spark, agent, root):
    rows = READERS[agent](spark, str(root)).select(*FIELDS, "date", "credits").collect()
    return sorted(rows, key=lambda r: (r.ts_ms, r.message_id or "", r.input_tokens))


def short(rows):
    return [(r.session_id, r.message_id, r.model, r.input_tokens, r.output_tokens, r.cache_creation_tokens, r.cache_read_tokens) for r in rows]


def usage_line(mid, req, ts="2025-01-01T00:00:00Z", tokens=(10, 5), **kw):
    return {"timestamp": ts, "sessionId": "s1", "version": "1.2.3", "requestId": req, "message": {"id": mid, "model": "m1", "usage": {"input_tokens": tokens[0], "output_tokens": tokens[1], **kw.pop("u", {})}}, **kw}


def test_claude(spark, tmp_path):
    root = tmp_path / "projects/p1"
    put(root, "a.jsonl", usage_line("msg_1", "r1"), usage_line("msg_1", "r1", tokens=(10, 9)), "broken", '{"usage":{', usage_line("msg_2", "r2", u={"cache_creation": {"ephemeral_5m_input_tokens": 3, "ephemeral_1h_input_tokens": 4}, "cache_creation_input_tokens": 99}))
    put(root, "sub/subagents/b.jsonl", usage_line("msg_1", "r9", isSidechain=True), usage_line("msg_3", "", ts="2025-01-02T00:00:00.250+01:00"), usage_line("msg_4", "r4", version="dev"), usage_line("msg_5", "r5", ts="2025-01-01 00:00:00Z"))
    put(root, "c.jsonl", {"type": "progress", "timestamp": "2025-01-01T00:00:01Z", "data": {"message": usage_line("msg_6", "r6", ts="2025-01-01T00:00:02Z")}}, usage_line("msg_7", "r7", ts="2025-01-01T00:00:03Z", u={"iterations": [{"type": "advisor_message", "model": "m2", "input_tokens": 7, "output_tokens": 1}, {"type": "other", "input_tokens": 1}]}))
    rows = run(spark, "claude", tmp_path)
    assert short(rows) == [("s1", "msg_1", "m1", 10, 9, 0, 0), ("s1", "msg_2", "m1", 10, 5, 7, 0), ("s1", "msg_6", "m1", 10, 5, 0, 0), ("s1", "msg_7", "m1", 10, 5, 0, 0), ("s1", "msg_7:advisor:0", "m2", 7, 1, 0, 0)]
    put(root, "err.jsonl", {"isApiErrorMessage": True, "message": {"content": [{"text": "Claude AI usage limit reached|1735700000"}]}})
    assert [r.reset_s for r in agents.limit_resets(spark, str(tmp_path)).collect()] == [1735700000]


def count(ts, total, last=None):
    u = lambda i, o: {"input_tokens": i, "cached_input_tokens": 0, "output_tokens": o, "total_tokens": i + o}
    return {"timestamp": ts, "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": u(*total), **({"last_token_usage": u(*last)} if last else {})}}}


def test_codex_totals_forks_and_compactions(spark, tmp_path):
    head = lambda i, up=None, ts="2025-01-01T00:00:00Z": {"timestamp": ts, "type": "session_meta", "payload": {"id": i, **({"forked_from_id": up} if up else {})}}
    turn = lambda m: {"timestamp": "2025-01-01T00:00:00Z", "type": "turn_context", "payload": {"model": m}}
    parent = [head("a"), turn("m1"), count("2025-01-01T00:01:00Z", (10, 1)), count("2025-01-01T00:02:00Z", (30, 2)), count("2025-01-01T00:03:00Z", (30, 2)), turn("m2"), count("2025-01-01T00:04:00Z", (50, 5), (20, 3))]
    put(tmp_path, "sessions/a.jsonl", *parent)
    put(tmp_path, "archived_sessions/a.jsonl", *parent)
    put(tmp_path, "sessions/b.jsonl", head("b", "a", "2025-01-01T01:00:00Z"), turn("m1"), count("2025-01-01T01:00:00Z", (10, 1)), count("2025-01-01T01:00:00Z", (30, 2)), count("2025-01-01T01:05:00Z", (100, 9)))
    put(tmp_path, "sessions/c.jsonl", head("c", "gone", "2025-01-01T02:00:00Z"), turn("m1"), count("2025-01-01T02:00:00.1Z", (5, 1)), count("2025-01-01T02:00:00.2Z", (9, 2)), count("2025-01-01T02:10:00Z", (19, 3)))
    rec = lambda rid: {"timestamp": "2025-01-01T03:00:00Z", "type": "token_usage_record", "payload": {"response_id": rid, "model": "m1", "usage": {"input_tokens": 8, "cached_input_tokens": 3, "output_tokens": 2, "total_tokens": 10}}}
    put(tmp_path, "sessions/d.jsonl", head("d"), rec("r1"), rec("r1"), rec("r2"), {"timestamp": "2025-01-01T03:00:01Z", "type": "compacted", "payload": {"compaction_response_id": "r1"}})
    got = [(r[0], r[2], r[3], r[4], r[6]) for r in short(run(spark, "codex", tmp_path))]
    assert got == [("a", "m1", 10, 1, 0), ("a", "m1", 20, 1, 0), ("a", "m2", 20, 3, 0), ("b", "m1", 70, 7, 0), ("c", "m1", 10, 1, 0), ("d", "m1", 5, 2, 3)]


def test_copilot(spark, tmp_path):
    shut = lambda i, at, a, calls: {"type": "session.shutdown", "id": i, "timestamp": at, "data": {"modelMetrics": {"m-1m": {"usage": {"inputTokens": a, "outputTokens": 1 * calls, "cacheReadTokens": 0, "cacheWriteTokens": 0}, "requests": {"count": calls}, "totalNanoAiu": 2_000_000_000 * calls}}}}
    put(tmp_path, "session-state/s1/events.jsonl", shut("x", "2025-01-01T00:00:00Z", 10, 1), "", "not json", shut("x", "2025-01-01T00:00:01Z", 12, 1), shut("y", "2025-01-01T01:00:00Z", 30, 3))
    span = lambda kind, resp, sec, trace="t1", **kw: {"type": kw.get("type", "span"), "traceId": trace, "spanId": "p", "name": "x", "endTime": [sec, 5_000_000], "attributes": {"gen_ai.operation.name": kind, "gen_ai.response.model": "m", "gen_ai.response.id": resp, "gen_ai.conversation.id": "s9", "gen_ai.usage.input_tokens": "7", "gen_ai.usage.output_tokens": "2"}}
    put(tmp_path, "otel/trace.jsonl", span("chat", "r1", 1735700000), span("chat", "r1", 1735700001), span("invoke_agent", "r5", 1735700002), span("invoke_agent", "r6", 1735700003, "t2"))
    rows = run(spark, "copilot", tmp_path)
    assert [(r.session_id, r.model, r.input_tokens, r.output_tokens) for r in rows] == [("s1", "m", 12, 1), ("s1", "m", 18, 2), ("s9", "m", 7, 2), ("s9", "m", 7, 2)]
    assert [r.credits for r in rows] == [2.0, 4.0, None, None] and rows[2].ts_ms == 1735700000005


def test_gemini_qwen_kimi(spark, tmp_path):
    g = tmp_path / "g"
    tok = {"input": 10, "output": 3, "cached": 4, "thoughts": 2, "tool": 0, "total": 15}
    put(g, "chat.jsonl", {"sessionId": "s", "projectHash": "h", "startTime": "x"}, {"id": "1", "timestamp": "2025-01-01T00:00:00Z", "type": "gemini", "model": "m", "tokens": tok}, {"id": "1", "timestamp": "2025-01-01T00:00:00Z", "type": "gemini", "model": "m", "tokens": tok | {"total": 99}})
    put(g, "old.json", {"sessionId": "s2", "messages": [{"id": "2", "timestamp": "2025-01-01T00:00:01Z", "type": "gemini", "model": "m", "tokens": tok}, {"id": "3", "type": "user"}]})
    assert [(r[0], r[3], r[4], r[6]) for r in short(run(spark, "gemini", g))] == [("s", 10, 5, 4), ("s2", 6, 5, 4)]
    q = tmp_path / "q"
    row = {"type": "assistant", "timestamp": "2025-01-01T00:00:00Z", "model": "m", "usageMetadata": {"promptTokenCount": 10, "candidatesTokenCount": 3, "thoughtsTokenCount": 1, "cachedContentTokenCount": 4, "totalTokenCount": 20}}
    put(q, "projects/pp/chats/c1.jsonl", row, row, row | {"sessionId": "z"})
    got = run(spark, "qwen", q)
    assert {(r.session_id, r.input_tokens, r.output_tokens, r.extra_total_tokens, r.cache_read_tokens) for r in got} == {("pp-c1", 6, 4, 6, 4), ("z", 6, 4, 6, 4)}
    k = tmp_path / "k"
    put(k, "sessions/s1/wire.jsonl", {"timestamp": 1735689600.5, "message": {"type": "StatusUpdate", "payload": {"message_id": "a", "token_usage": {"input_other": 5, "output": 2, "input_cache_read": 1, "input_cache_creation": 3}}}}, {"type": "usage.record", "usageScope": "turn", "time": T + 1000, "model": "m", "usage": {"inputOther": 6, "output": 2, "inputCacheRead": 0, "inputCacheCreation": 0}}, {"type": "usage.record", "usageScope": "session", "time": T + 2000, "model": "m", "usage": {"inputOther": 600, "output": 2}})
    got = run(spark, "kimi", k)
    assert [(r.session_id, r.ts_ms - T, r.input_tokens, r.cache_creation_tokens) for r in got] == [("s1", 500, 5, 3), ("s1", 1000, 6, 0)]


def test_grok_pi_openclaw(spark, tmp_path):
    g = tmp_path / "g"
    one = {"inputTokens": 10, "outputTokens": 2, "cachedReadTokens": 4, "reasoningTokens": 1, "totalTokens": 12}
    turn = lambda e, u: {"params": {"sessionId": "s", "_meta": {"eventId": e}, "update": {"sessionUpdate": "turn_completed", "usage": u}}}
    put(g, "sessions/x/updates.jsonl", turn("e1", one | {"modelUsage": {"m1": one, "m2": one | {"costUsdTicks": 20_000_000_000}}}), turn("e2", one))
    put(g, "sessions/x/summary.json", {"model": "m9", "cwd": "/a%20b", "updatedAt": "2025-01-01T00:00:00Z"})
    assert [(r.message_id, r.model, r.input_tokens, r.cost_usd) for r in sorted(run(spark, "grok", g), key=lambda r: (r.message_id, r.model))] == [("e1", "m1", 6, None), ("e1", "m2", 6, 2.0), ("e2", "m9", 6, None)]
    p = tmp_path / "p"
    said = lambda i, n: {"type": "message", "id": i, "timestamp": "2025-01-01T00:00:00Z", "message": {"role": "assistant", "model": "m", "usage": {"input": n, "output": 1, "cacheRead": 0, "cacheWrite": 0, "cost": {"total": 0.5}}}}
    put(p, "a.jsonl", {"type": "session", "id": "A"}, said("1", 5), said("2", 6))
    put(p, "b.jsonl", {"type": "session", "id": "B", "parentSession": "A"}, said("1", 5), said("3", 7))
    put(p, "subagent-artifacts/z.jsonl", {"type": "session", "id": "Z"}, said("9", 9))
    assert [r[:4] for r in short(run(spark, "pi", p))] == [("A", "1", "m", 5), ("A", "2", "m", 6), ("B", "3", "m", 7)]
    o = tmp_path / "o"
    ev = lambda i, n: {"type": "message", "id": i, "message": {"role": "assistant", "timestamp": T, "usage": {"input": n, "output": 1}}}
    put(o, "s1.jsonl", {"type": "model_change", "provider": "v", "modelId": "m1"}, ev("1", 5), {"type": "model_change", "modelId": "m2"}, ev("2", 6))
    db(o, "agent.db", ("create table transcript_events(session_id text, seq int, event_json text, created_at int)",), ("insert into transcript_events values('s1', 1, ?, 0)", json.dumps({"type": "model_change", "modelId": "m3"})), ("insert into transcript_events values('s1', 2, ?, 0)", json.dumps(ev("2", 60))))
    assert [r[:4] for r in short(run(spark, "openclaw", o))] == [("s1", "1", "m1", 5), ("s1", "2", "m3", 60)]


def test_document_sources(spark, tmp_path):
    a = tmp_path / "a"
    put(a, "threads/t1.json", {"id": "t1", "messages": [{"role": "assistant", "messageId": "9", "usage": {"cacheReadInputTokens": 4, "cacheCreationInputTokens": 2}}], "usageLedger": {"events": [{"id": "e", "timestamp": "2025-01-01T00:00:00Z", "model": "m", "credits": 1.5, "tokens": {"input": 10, "output": 3, "total": 13}, "toMessageId": "9"}]}})
    put(a, "threads/t2.json", {"id": "t2", "messages": [{"role": "assistant", "messageId": "1", "timestamp": "2025-01-01T00:00:01Z", "usage": {"model": "m", "inputTokens": 7, "outputTokens": 1}}]})
    put(a, "threads/bad.json", "{")
    assert short(run(spark, "amp", a)) == [("t1", "e", "m", 10, 3, 2, 4), ("t2", "1", "m", 7, 1, 0, 0)]
    d = tmp_path / "d"
    put(d, "x.settings.json", {"providerLockTimestamp": "2025-01-01T00:00:00Z", "tokenUsage": {"inputTokens": 5, "outputTokens": 2, "thinkingTokens": 1}})
    put(d, "x.jsonl", {"model": "beside"})
    put(d, "y.settings.json", {"model": "own", "providerLockTimestamp": "2025-01-01T00:00:01Z", "tokenUsage": {"inputTokens": 1}})
    assert [(r.session_id, r.model, r.input_tokens, r.output_tokens) for r in run(spark, "droid", d)] == [("x", "beside", 5, 3), ("y", "own", 1, 0)]
    b = tmp_path / "b"
    put(b, "chan/projects/pr/chats/c1/chat-messages.json", [{"id": "1", "variant": "ai", "timestamp": "2025-01-01T00:00:00Z", "credits": 2.0, "metadata": {"model": "m", "codebuff": {"usage": {"input_tokens": 5, "output_tokens": 1}}}}, {"id": "2", "variant": "user"}])
    assert [(r.input_tokens, r.credits) for r in run(spark, "codebuff", b)] == [(5, 2.0)]
    k = tmp_path / "k"
    put(k, "tasks/t/ui_messages.json", [{"ts": T, "type": "say", "say": "api_req_started", "modelInfo": {"modelId": "unknown"}, "text": json.dumps({"tokensIn": 3, "tokensOut": 1, "cacheReads": 2, "cost": 0.1})}, {"ts": T, "say": "api_req_started", "partial": True, "text": "{}"}])
    put(k, "s.messages.json", {"version": 1, "sessionId": "s", "messages": [{"role": "assistant", "ts": T + 5, "id": "m1", "modelInfo": {"id": "mm", "provider": "p"}, "metrics": {"inputTokens": 4, "outputTokens": 1, "cost": 0.2}}]})
    assert short(run(spark, "cline", k)) == [("t", None, None, 3, 1, 0, 2), ("s", "m1", "mm", 4, 1, 0, 0)]


def test_databases(spark, tmp_path):
    o = tmp_path / "o"
    msg = lambda i, n: json.dumps({"id": i, "sessionID": "f", "modelID": "m", "providerID": "p", "time": {"created": T}, "tokens": {"input": n, "output": 1, "reasoning": 2, "cache": {"read": 3, "write": 4}}, "cost": 0.5})
    db(o, "opencode.db", ("create table message(id text, session_id text, data text, time_created int)",), ("insert into message values('a', 's', ?, 1)", msg("a", 5)), ("insert into message values('b', 's', 'torn', 1)",))
    put(o, "storage/message/a.json", msg("a", 50))
    put(o, "storage/message/c.json", msg("c", 7))
    assert [(r.session_id, r.message_id, r.input_tokens, r.extra_total_tokens) for r in run(spark, "opencode", o)] == [("s", "a", 5, 2), ("f", "c", 7, 2)]
    k = tmp_path / "k"
    db(k, "kilo.db", ("create table message(id text, session_id text, data text)",), ("insert into message values('a', 's', ?)", msg("a", 5)))
    assert [r.input_tokens for r in run(spark, "kilo", k)] == [5]
    g = tmp_path / "g"
    db(g, "sessions.db", ("create table sessions(id text, model_config_json text, provider_name text, created_at text, total_tokens int, input_tokens int, output_tokens int)",), ("insert into sessions values('s', '{\"model_name\":\"m\"}', 'p', '2025-01-01 00:00:00', 20, 10, 5)",))
    assert [(r.model, r.input_tokens, r.output_tokens, r.extra_total_tokens, r.ts_ms) for r in run(spark, "goose", g)] == [("m", 10, 5, 5, T)]
    h = tmp_path / "h"
    db(h, "state.db", ("create table sessions(id text, model text, started_at real, message_count int, input_tokens int, output_tokens int, actual_cost_usd real)",), ("insert into sessions values('s', 'm', 1735689600.0, 3, 10, 5, 0.25)",), ("insert into sessions values('z', 'm', 1735689600.0, 0, 0, 0, null)",))
    assert [(r.session_id, r.cost_usd, r.ts_ms) for r in run(spark, "hermes", h)] == [("s", 0.25, T)]
    z = tmp_path / "z"
    db(z, "z.db", ("create table model_usage(id text, session_id text, started_at int, model_id text, input_tokens int, output_tokens int, cache_read_tokens int, status text)",), ("create table session(id text, directory text)",), ("insert into session values('s', '/d')",), (f"insert into model_usage values('u', 's', {T}, 'm', 10, 2, 4, 'completed'), ('v', 's', {T}, 'm', 10, 2, 4, 'failed')",))
    assert [(r.message_id, r.input_tokens, r.cache_read_tokens) for r in run(spark, "zcode", z)] == [("u", 6, 4)]
    assert run(spark, "kilo", tmp_path / "nothing-here" if (tmp_path / "nothing-here").mkdir() is None else "") == []


def test_opencode_forks_aggregates_and_compactions(spark, tmp_path):
    data = lambda n, **kw: json.dumps({"model": {"id": "m", "providerID": "p"}, "time": {"created": T}, "tokens": {"input": n, "output": 1}, **kw})
    row = lambda *v: ("insert into session_message values(?, ?, ?, ?, ?, 1)", *v)
    total = lambda table, s, n, model=None: (f"insert into {table}(id, time_created, cost, tokens_input, tokens_output, tokens_cache_read, tokens_cache_write, model) values(?, ?, 0.5, ?, 0, 0, 0, ?)", s, T, n, model)
    fork = lambda s, side, at: ("insert into session_v2(id, fork_session_id, fork_boundary) values(?, 'up', ?)", s, json.dumps({"type": side, "messageID": at}))
    sums = "time_created int, cost real, tokens_input int, tokens_output int, tokens_cache_read int, tokens_cache_write int, model text"
    db(
        tmp_path, "opencode.db", ("create table session_message(id text, session_id text, type text, seq int, data text, time_created int)",), (f"create table session_v2(id text, fork_session_id text, fork_boundary text, {sums})",), (f"create table session(id text, {sums})",),
        row("u1", "up", "assistant", 2, data(1)), row("u2", "up", "assistant", 5, data(2)), row("u3", "up", "user", 6, data(99)),
        fork("thru", "through", "u2"), row("t1", "thru", "assistant", 2, data(1)), row("t2", "thru", "assistant", 5, data(2)), row("t3", "thru", "assistant", 6, data(4)), row("t4", "thru", "assistant", None, data(5)),
        fork("bef", "before", "u2"), row("b1", "bef", "assistant", 2, data(1)), row("b3", "bef", "assistant", 3, data(8)),
        fork("lost", "through", "gone"), row("l1", "lost", "assistant", 2, data(1)),
        row("c1", "comp", "compaction", 1, data(16, status="completed")), row("c2", "comp", "compaction", 2, data(32, status="failed")),
        row("c3", "both", "compaction", 1, data(64, status="completed")), total("session_v2", "both", 200, '{"id":"mm","providerID":"pp"}'), total("session", "both", 300),
        total("session_v2", "up", 400), total("session", "alone", 500, "plain"),
    )
    db(tmp_path, "older.db", (f"create table session(id text, {sums})",), total("session", "v1", 600))
    said = {("up", "u1", 1), ("up", "u2", 2), ("thru", "t3", 4), ("thru", "t4", 5), ("bef", "b3", 8), ("lost", "l1", 1), ("comp", "c1", 16)}
    assert {(r.session_id, r.message_id, r.input_tokens) for r in run(spark, "opencode", tmp_path)} == said | {("both", "c3", 64)}
    got = agents.read_all(spark, {"opencode": str(tmp_path)}, aggregates=True).collect()
    assert {(r.session_id, r.message_id, r.input_tokens) for r in got} == said | {("both", "session:both", 200), ("alone", "session:alone", 500)}
    assert {(r.model, r.provider) for r in got} == {("m", "p"), ("mm", "pp"), ("plain", "unknown")} and len(got) == len(said) + 2


def enc(number, value):
    def v(x):
        out = b""
        while True:
            out += bytes([x & 0x7F | (0x80 if x > 0x7F else 0)])
            x >>= 7
            if not x:
                return out

    return v(number << 3) + v(value) if isinstance(value, int) else v(number << 3 | 2) + v(len(value)) + value


def test_gemini_stats_and_single_records(spark, tmp_path):
    models = {"a": {"tokens": {"prompt": 10, "candidates": 3, "cached": 4, "thoughts": 2, "tool": 1, "total": 16}}, "b": {"tokens": {"input": 7.9, "total": 9}}, "idle": {"tokens": {"prompt": 0}}, "odd": 5}
    ts = lambda s: {"timestamp": f"2025-01-01T00:00:0{s}Z"}
    put(tmp_path, "x.jsonl", {"session_id": "s", "model": "hint"}, {"type": "result", **ts(1), "stats": {"models": models}}, {**ts(2), "result": {"stats": {"input_tokens": 5, "output_tokens": 1}}}, {"type": "gemini", "id": "1", **ts(3), "tokens": {"input": 2}}, {**ts(4), "stats": {"models": {"idle": {"tokens": {}}}, "total_tokens": 6}})
    put(tmp_path, "one.json", {"type": "gemini", "sessionId": "t", "id": "2", "model": "m", **ts(5), "tokens": {"input": 8, "output": 1}})
    put(tmp_path, "sum.json", {**ts(6), "stats": {"input": 11, "cached": 20}})
    put(tmp_path, "new.json", {"stats": {"input": 12}})
    rows = run(spark, "gemini", tmp_path)
    got = sorted((r.session_id, r.model, r.input_tokens, r.output_tokens, r.cache_read_tokens, r.extra_total_tokens) for r in rows)
    assert got == [("new", "unknown", 12, 0, 0, 0), ("s", "a", 7, 5, 4, 0), ("s", "b", 7, 2, 0, 0), ("s", "hint", 0, 6, 0, 0), ("s", "hint", 2, 0, 0, 0), ("s", "hint", 5, 1, 0, 0), ("sum", "unknown", 0, 0, 20, 0), ("t", "m", 8, 1, 0, 0)]


def test_antigravity(spark, tmp_path):
    u = enc(2, 100) + enc(3, 30) + enc(5, 7) + enc(11, b"resp-1")
    blob = enc(1, enc(4, u) + enc(19, b"model-x") + enc(9, enc(4, enc(1, T // 1000) + enc(2, 500_000_000))))
    step = enc(8, enc(1, T // 1000)) + enc(9, u)
    db(tmp_path, "g.db", ("create table gen_metadata(idx int, data blob)",), ("create table steps(idx int, metadata blob)",), ("insert into gen_metadata values(0, ?)", blob), ("insert into gen_metadata values(1, ?)", b"\xff\xff"), ("insert into steps values(0, ?)", step))
    rows = run(spark, "antigravity", tmp_path)
    assert [(r.message_id, r.model, r.ts_ms, r.input_tokens, r.output_tokens, r.cache_read_tokens) for r in rows] == [("i:resp-1", "model-x", T + 500, 100, 30, 7)]
    assert wire.generation(b"\xff\xff") is None and wire.step(None)["model"] is None


def test_antigravity_calls_by_any_id(spark, tmp_path):
    use = lambda n, **ids: enc(2, n) + enc(3, 1) + b"".join(enc({"message": 7, "response": 11, "provider": 12}[k], v.encode()) for k, v in ids.items())
    when = enc(1, T // 1000)
    gen = lambda u, more=b"", steps=b"": enc(1, enc(4, u) + enc(19, b"m") + enc(9, enc(4, when)) + more) + steps
    step = lambda u, more=b"": enc(8, when) + enc(9, u) + more
    again = lambda n, u: enc(n, enc(2, u))
    db(
        tmp_path, "g.db", ("create table gen_metadata(idx int, data blob)",), ("create table steps(idx int, metadata blob)",),
        ("insert into gen_metadata values(0, ?)", gen(use(10, response="r", message="a"))), ("insert into steps values(0, ?)", step(use(12, message="a", provider="p"))), ("insert into steps values(1, ?)", step(use(11, provider="p"))),
        ("insert into gen_metadata values(1, ?)", gen(use(20), steps=enc(2, 2) + enc(2, bytes([3])))), ("insert into steps values(2, ?)", step(use(21))), ("insert into steps values(3, ?)", step(use(19))),
        ("insert into gen_metadata values(4, ?)", gen(use(30, response="s"), again(17, use(30, response="s")) + again(17, use(31, response="t")) + again(17, use(32)))), ("insert into steps values(4, ?)", step(use(33), again(28, use(33)) + again(28, b"\xff"))),
    )
    rows = run(spark, "antigravity", tmp_path)
    assert sorted(r.input_tokens for r in rows) == [12, 21, 30, 31, 32, 33]
    assert {r.input_tokens: r.message_id for r in rows if r.message_id.startswith("i:")} == {12: "i:r", 30: "i:s", 31: "i:t"}
    assert {r.model for r in rows if r.input_tokens != 33} == {"m"}


def test_line_order_compression_and_pushdown(spark, tmp_path):
    put(tmp_path, "a.jsonl", *[{"n": i} for i in range(2000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        got = [json.loads(r.raw)["n"] for r in lines(spark, str(tmp_path)).orderBy("src_file", "seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(range(2000))
    db(tmp_path, "x.db", ("create table t(a int, b text)",), ("insert into t values(1, 'x'), (2, 'y'), (3, null)",))
    df = read_table(spark, str(tmp_path), "t", "a bigint, b string, missing string, src_file string").filter(F.col("a") >= 2)
    assert sorted((r.a, r.b, r.missing) for r in df.collect()) == [(2, "y", None), (3, None, None)]
    assert read_table(spark, str(tmp_path), "absent", "a bigint").count() == 0


def test_all_sources_together(spark, tmp_path):
    put(tmp_path / "c", "projects/p/s.jsonl", usage_line("msg_1", "r1"))
    msg = lambda i, s, prov: {"id": i, "sessionID": s, "modelID": "m", "providerID": prov, "time": {"created": T}, "tokens": {"input": 1, "output": 1}}
    put(tmp_path / "o", "a.json", msg("a", "s1", "claude-agent"))
    put(tmp_path / "o", "b.json", msg("b", "s1", "other"))
    got = agents.read_all(spark, {"claude": str(tmp_path / "c"), "opencode": str(tmp_path / "o")}).collect()
    assert sorted((r.agent, r.message_id) for r in got) == [("claude", "msg_1"), ("opencode", "b")]


def test_every_agent_has_a_reader():
    assert len(READERS) == 19


if __name__ == "__main__":
    pytest.main([__file__])
