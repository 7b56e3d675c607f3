import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from usagemill.operators.quarantine import csv_fields, load_valid, quarantine, strict_object

HEAD = "s,m,t,user,mod,prov"


def line(tokens="5", meta="", n=7):
    return ",".join([HEAD, tokens, "1", "2", "3", "0.1", meta][:n])


CASES = [
    ("codex_jsonl", '{"payload":{}}', None),
    ("codex_jsonl", ' \n{"payload":{"metadata":null}}\t', None),
    ("codex_jsonl", '{"payload":{"metadata":{"a":[1,2]}}}', None),
    ("codex_jsonl", '{"payload":{"metadata":""}}', "invalid_value"),
    ("codex_jsonl", '{"payload":{"metadata":[]}}', "invalid_value"),
    ("codex_jsonl", '{"payload":{"metadata":7}}', "invalid_value"),
    ("codex_jsonl", '{"payload":3}', None),
    ("codex_jsonl", "{}{}", "bad_json"),
    ("codex_jsonl", "[1]", "bad_json"),
    ("codex_jsonl", '{"a":NaN}', "bad_json"),
    ("codex_jsonl", '{"a":01}', "bad_json"),
    ("codex_jsonl", "{'a':1}", "bad_json"),
    ("codex_jsonl", '{"a":1,}', "bad_json"),
    ("codex_jsonl", '﻿{"a":1}', "bad_json"),
    ("codex_jsonl", ' {"a":1}', "bad_json"),
    ("codex_jsonl", '{"a":"x\ty"}', "bad_json"),
    ("codex_jsonl", "", "bad_json"),
    ("codex_jsonl", None, "bad_json"),
    ("codex_jsonl", '{"a":' + "9" * 6000 + "}", None),
    ("codex_jsonl", '{"a":' + "[" * 20000 + "]" * 20000 + ',"payload":{"metadata":1}}', "invalid_value"),
    ("codex_jsonl", '{"a":' + "[" * 20000 + "]" * 19999 + "}", "bad_json"),
    ("cline_json", '{"session":{"metrics":{"inputTokens":5}}}', None),
    ("cline_json", '{"session":{"metrics":{"inputTokens":" 07 "}}}', None),
    ("cline_json", '{"session":{"metrics":{"inputTokens":9223372036854775807}}}', None),
    ("cline_json", '{"session":{"metrics":{"inputTokens":9223372036854775808}}}', "invalid_value"),
    ("cline_json", '{"session":{"metrics":{"inputTokens":5.0}}}', "invalid_value"),
    ("cline_json", '{"session":{"metrics":{"inputTokens":1e3}}}', "invalid_value"),
    ("cline_json", '{"session":{"metrics":{"inputTokens":-0}}}', "invalid_value"),
    ("cline_json", '{"session":{"metrics":{"inputTokens":"٥"}}}', "invalid_value"),
    ("cline_json", '{"session":{"metrics":{"inputTokens":"5\\n"}}}', "invalid_value"),
    ("cline_json", '{"session":{"metrics":{"inputTokens":"\\ud800"}}}', "invalid_value"),
    ("cline_json", '{"session":{"metrics":{"inputTokens":true}}}', "invalid_value"),
    ("cline_json", '{"session":{"metrics":{"inputTokens":{"n":3}}}}', "invalid_value"),
    ("cline_json", '{"session":{"metrics":{"inputTokens":""}}}', "invalid_value"),
    ("cline_json", '{"session":{"metrics":{"inputTokens":null}}}', "invalid_value"),
    ("cline_json", '{"session":{"metrics":[]}}', "invalid_value"),
    ("cline_json", '{"session":1}', "invalid_value"),
    ("cline_csv", line(), None),
    ("cline_csv", line(" 12 "), None),
    ("cline_csv", line('"12"'), None),
    ("cline_csv", line("000000000000000000000000000012"), None),
    ("cline_csv", line(""), "invalid_value"),
    ("cline_csv", line("1.5"), "invalid_value"),
    ("cline_csv", line("+5"), "invalid_value"),
    ("cline_csv", line(meta='"{""a"": ""b\nc""}"'), "invalid_value"),
    ("cline_csv", line(meta='"{""a"": ""b""}"'), None),
    ("cline_csv", line(meta="[]"), "invalid_value"),
    ("cline_csv", line(meta=" "), "invalid_value"),
    ("cline_csv", line(n=6), "column_count"),
    ("cline_csv", line() + ",", "column_count"),
    ("cline_csv", "", "column_count"),
    ("cline_csv", None, "column_count"),
    ("cline_csv", line('"1'), "bad_quoting"),
    ("cline_csv", line('"1"x'), "bad_quoting"),
    ("cline_csv", line('1"'), "bad_quoting"),
    ("cline_csv", '"a\nb"' + line()[1:], None),
    (None, "x", "unknown_layout"),
    ("other", "x", "unknown_layout"),
]


def frame(spark, cases):
    return spark.createDataFrame([(i, a, b, "clash") for i, (a, b, *_) in enumerate(cases)], "record_id bigint, layout string, raw string, reason string")


def run(spark, cases):
    return quarantine(frame(spark, cases), F.col("record_id"), F.col("layout"), F.col("raw"))


def test_reasons(spark):
    got = {r.record_id: r.reason for r in run(spark, CASES).collect()}
    for i, (layout, raw, reason) in enumerate(CASES):
        assert got.get(i) == reason, (layout, (raw or "")[:80], got.get(i))


def test_valid_rows_are_loaded_and_typed(spark):
    got = load_valid(frame(spark, CASES), F.col("record_id"), F.col("layout"), F.col("raw")).collect()
    assert {r.record_id for r in got} == {i for i, c in enumerate(CASES) if c[2] is None}
    assert {r.input_tokens for r in got} >= {5, 7, 12, 9223372036854775807}


ROWS = [
    (
        "codex_jsonl",
        '{"timestamp":"t","type":"event_msg","payload":{"type":"token_count","model":"m","metadata":{"b":[1.50,{"é":null}],"a":"\\ud800","n":12345678901234567890},"usage":{"input_tokens":7,"output_tokens":9}}}',
        {"event_time": "t", "type": "event_msg", "payload_type": "token_count", "model": "m", "input_tokens": 7, "output_tokens": 9, "metadata": '{"b":[1.50,{"é":null}],"a":"\\ud800","n":12345678901234567890}'},
    ),
    ("codex_jsonl", '{"payload":{"usage":{"input_tokens":"x","output_tokens":-1}}}', {}),
    ("codex_jsonl", '{"payload":{"metadata":{}}}', {"metadata": "{}"}),
    ("codex_jsonl", '{"payload":{"metadata":{"a":' + "[" * 20000 + "]" * 20000 + "}}}", {"metadata": '{"a":' + "[" * 20000 + "]" * 20000 + "}"}),
    (
        "cline_json",
        '{"session":{"sessionId":"s","id":"i","role":"user","ts":12,"modelInfo":{"id":"m","provider":"p"},"metrics":{"inputTokens":" 5 ","outputTokens":6,"cacheReadTokens":7,"cacheWriteTokens":8,"cost":0.25}}}',
        {"session_id": "s", "message_id": "i", "role": "user", "event_time": "12", "model": "m", "provider": "p", "input_tokens": 5, "output_tokens": 6, "cache_read_tokens": 7, "cache_write_tokens": 8, "cost": 0.25},
    ),
    (
        "cline_csv",
        's,i,t,user,m,p,5,6,7,8,1e-2,"{""a"": 1.0}"',
        {"session_id": "s", "message_id": "i", "event_time": "t", "role": "user", "model": "m", "provider": "p", "input_tokens": 5, "output_tokens": 6, "cache_read_tokens": 7, "cache_write_tokens": 8, "cost": 0.01, "metadata": '{"a": 1.0}'},
    ),
]


def test_all_fields_of_each_layout_are_loaded(spark):
    got = {r.record_id: r.asDict() for r in load_valid(frame(spark, ROWS), F.col("record_id"), F.col("layout"), F.col("raw")).collect()}
    for i, (layout, _, want) in enumerate(ROWS):
        assert {k: v for k, v in got[i].items() if v is not None} == {"record_id": i, "layout": layout, **want}


def test_repeated_rows_and_empty_input(spark):
    twice = run(spark, [CASES[7]] * 3)
    assert twice.count() == 3
    assert run(spark, CASES[:0]).count() == 0


@pytest.mark.parametrize("text", ['{"a": {"b": [1, "x", null, true, {"c": -1.5e3}]}}', '{"a": "\\u00e9\\n"}', '{"a": 1 "b": 2}', '{"a" 1}', "{", '{"a":[1,]}', '{"a":tru}', "{}x", '{"":{}}'])
def test_deep_reader_agrees_with_the_fast_one(text):
    from usagemill.operators.quarantine import _deep_json

    try:
        deep = _deep_json(text)
    except ValueError:
        deep = None
    assert deep == strict_object(text)


@pytest.mark.parametrize("fields", [["a", "", 'q"x', "l\nm", ","], [""], ["", ""], ['"']])
def test_csv_round_trip(fields):
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(fields)
    text = out.getvalue()
    assert csv_fields(text) == fields


def test_on_the_tables(spark, data):
    df = spark.read.parquet(f"{data}/raw_records.parquet")
    got = {r.record_id: r.reason for r in quarantine(df, F.col("record_id"), F.col("layout"), F.col("raw")).collect()}
    for r in df.filter("layout = 'codex_jsonl'").collect():
        try:
            o = json.loads(r.raw, parse_constant=lambda c: 1 / 0)
            ok = isinstance(o, dict)
        except (ValueError, ZeroDivisionError):
            ok = False
        assert (got.get(r.record_id) == "bad_json") == (not ok)
