"""Rows that fail to parse: set them aside with a reason, load the others.

A structural pass reads every record once (strict JSON, or CSV with doubled
quotes) and pulls out the values of all its layout's fields. Each distinct judged
value per column is then cast once; the values that fail form a dictionary with
reasons, which is joined back to the records beside the structural findings.

Defined results
    a null record          bad_json in the JSON layouts, column_count in CSV
    an unknown layout      unknown_layout
    a repeated JSON key    the last one counts
    any nesting depth, any length of numbers and texts: judged like the rest
    equal rows             each is judged; the result has a row for each failure
    an unjudged number     null in the loaded row, if it isn't one of its type
    a loaded metadata      in CSV the text as it is, in codex_jsonl compact JSON
                           with numbers as written
    empty input            empty tables
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagemill.operators.skew import lookup_join
from usagemill.session import cut

CSV_COLUMNS = ("sessionId", "id", "timestamp", "role", "model", "provider", "inputTokens", "outputTokens", "cacheReadTokens", "cacheWriteTokens", "cost", "metadata")
MAX_LONG = "9223372036854775807"
#: The values of a record; tokens and metadata are judged, the others loaded as they are.
VALUES = ("tokens", "metadata", "session_id", "event_time", "model", "output_tokens", "input_tokens", "metadata_json", "message_id", "role", "provider", "type", "payload_type", "cache_read_tokens", "cache_write_tokens", "cost")
PARSED = ", ".join(["record_id bigint", *(f"{x} string" for x in ("layout", "structural", *VALUES))])
#: Stand for values that aren't text; no valid value begins with a NUL.
MISSING, OTHER = "\0missing", "\0other"


class Number(str):
    """A JSON number as it was written."""

    __slots__ = ()


def _no_constant(name: str) -> None:
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_no_constant)
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))')
_WORDS = {"true": True, "false": False, "null": None}


def _deep_json(text: str) -> object:
    """Strict JSON with a stack of its own, for texts nested too deeply for the C scanner."""
    pos, stack, done, result = 0, [], False, None
    key, expect = None, "value"
    end = len(text.rstrip(" \t\n\r"))
    while pos < end:
        m = _TOKEN.match(text, pos)
        if not m or done:
            raise ValueError(pos)
        pos = m.end()
        mark, string, number, word = m.groups()
        if mark in ("{", "["):
            if expect not in ("value", "first"):
                raise ValueError(pos)
            box: dict | list = {} if mark == "{" else []
            stack.append((box, key))
            expect = "key_or_end" if mark == "{" else "first"
            continue
        if mark in ("}", "]"):
            if not stack or isinstance(stack[-1][0], dict) != (mark == "}") or expect not in ("comma", "key_or_end", "first"):
                raise ValueError(pos)
            value, key = stack.pop()
        elif mark == ",":
            if expect != "comma" or not stack:
                raise ValueError(pos)
            expect = "key" if isinstance(stack[-1][0], dict) else "value"
            continue
        elif mark == ":":
            if expect != "colon":
                raise ValueError(pos)
            expect = "value"
            continue
        elif string is not None and expect in ("key", "key_or_end"):
            key, expect = json.loads(string), "colon"
            continue
        else:
            if expect not in ("value", "first"):
                raise ValueError(pos)
            value = json.loads(string) if string is not None else Number(number) if number is not None else _WORDS[word]
        if not stack:
            done, result = True, value
        elif isinstance(stack[-1][0], dict):
            stack[-1][0][key] = value
        else:
            stack[-1][0].append(value)
        expect = "comma"
    if not done:
        raise ValueError(pos)
    return result


def strict_object(text: str | None) -> dict | None:
    """The object, if text is exactly one object of strict JSON, else None. Numbers stay as written."""
    if text is None:
        return None
    try:
        try:
            value = _DECODER.decode(text)
        except RecursionError:
            value = _deep_json(text)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


_FIELD = re.compile(r'(?:"([^"]*(?:""[^"]*)*)"|([^",]*))(?:(,)|\Z)', re.S)


def csv_fields(text: str) -> list[str] | None:
    """The fields of one record, or None if its quoting is broken."""
    fields, pos = [], 0
    while True:
        m = _FIELD.match(text, pos)
        if not m:
            return None
        fields.append(m.group(1).replace('""', '"') if m.group(1) is not None else m.group(2))
        pos = m.end()
        if not m.group(3):
            return fields


def _text(value: object) -> str:
    """A judged value as the dictionary's key."""
    if value is None:
        return MISSING
    if isinstance(value, str):
        return value.encode("utf-8", "replace").decode()
    return OTHER


def _plain(value: object) -> str | None:
    return value.encode("utf-8", "replace").decode() if isinstance(value, str) else None


def _json_text(value: object) -> str:
    """Compact JSON with numbers as they were written, at any depth; halves of surrogate pairs stay escaped."""
    out, stack = [], [value]
    quote = lambda x: json.dumps(x, ensure_ascii=False)
    while stack:
        v = stack.pop()
        if isinstance(v, Number):
            out.append(v)
        elif isinstance(v, dict):
            parts = [x for i, (k, item) in enumerate(v.items()) for x in (Number(("," if i else "") + quote(k) + ":"), item)]
            stack += [Number("}"), *reversed(parts), Number("{")]
        elif isinstance(v, list):
            parts = [x for i, item in enumerate(v) for x in (Number("," if i else ""), item)]
            stack += [Number("]"), *reversed(parts), Number("[")]
        else:
            out.append(quote(v))
    return "".join(out).encode("utf-8", "backslashreplace").decode()


def _dig(value: object, *path: str) -> object:
    for p in path:
        value = value.get(p) if isinstance(value, dict) else None
    return value


def _values(**values: str | None) -> tuple:
    return tuple(values.get(x) for x in VALUES)


def parse_record(layout: str | None, raw: str | None) -> tuple:
    """(structural, *VALUES) of one record."""
    if layout in ("codex_jsonl", "cline_json"):
        top = strict_object(raw)
        if top is None:
            return ("bad_json", *_values())
        if layout == "codex_jsonl":
            at = lambda *path: _plain(_dig(top, *path))
            meta = _dig(top, "payload", "metadata")
            sound = isinstance(meta, dict)
            return (None, *_values(
                metadata=None if meta is None or sound else OTHER, metadata_json=_json_text(meta) if sound else None, event_time=at("timestamp"), type=at("type"), payload_type=at("payload", "type"), model=at("payload", "model"),
                input_tokens=at("payload", "usage", "input_tokens"), output_tokens=at("payload", "usage", "output_tokens"),
            ))
        at = lambda *path: _plain(_dig(top, "session", *path))
        return (None, *_values(
            tokens=_text(_dig(top, "session", "metrics", "inputTokens")), session_id=at("sessionId"), message_id=at("id"), role=at("role"), event_time=at("ts"), model=at("modelInfo", "id"), provider=at("modelInfo", "provider"),
            output_tokens=at("metrics", "outputTokens"), cache_read_tokens=at("metrics", "cacheReadTokens"), cache_write_tokens=at("metrics", "cacheWriteTokens"), cost=at("metrics", "cost"),
        ))
    if layout == "cline_csv":
        fields = csv_fields(raw or "")
        if fields is None:
            return ("bad_quoting", *_values())
        if len(fields) != len(CSV_COLUMNS):
            return ("column_count", *_values())
        row = dict(zip(CSV_COLUMNS, fields))
        return (None, *_values(
            tokens=row["inputTokens"], metadata=row["metadata"] or None, session_id=row["sessionId"], message_id=row["id"], role=row["role"], event_time=row["timestamp"], model=row["model"], provider=row["provider"],
            output_tokens=row["outputTokens"], cache_read_tokens=row["cacheReadTokens"], cache_write_tokens=row["cacheWriteTokens"], cost=row["cost"],
        ))
    return ("unknown_layout", *_values())


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "layout", "structural", *VALUES]
    for batch in batches:
        rows = [parse_record(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        columns = list(zip(*rows)) if rows else [[]] * (len(VALUES) + 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.string()) for c in columns)], names=names)


def _judge_objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the texts that aren't exactly one strict JSON object."""
    for batch in batches:
        bad = [t for t in batch.column(0).to_pylist() if t == OTHER or strict_object(t) is None]
        yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], names=["metadata"])


def whole_number(text: Column) -> Column:
    """Whether text is 0 to 2^63 - 1 in the digits 0-9 alone, spaces around allowed."""
    digits = F.regexp_extract(text, r"^ *0*([0-9]*) *$", 1)
    short = (F.length(digits) < 19) | ((F.length(digits) == 19) & (digits <= MAX_LONG))
    return text.rlike(r"^ *[0-9]+ *\z") & short


def decimal_number(text: Column) -> Column:
    """text as a double, null unless it is a number in decimal digits, spaces around allowed."""
    return F.when(text.rlike(r"^ *[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)? *\z"), F.trim(text).try_cast("double"))


def parse(df: DataFrame, record_id: Column, layout: Column, raw: Column) -> DataFrame:
    """The structural pass; written, as the dictionaries and the join both read it."""
    three = df.select(record_id.cast("bigint").alias("record_id"), layout.alias("layout"), raw.alias("raw"))
    return cut(three.mapInArrow(_parse, PARSED), "parsed")


def invalid_values(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dictionaries (value, reason) of the distinct values per column whose cast fails."""
    sound = parsed.filter(F.col("structural").isNull())
    tokens = sound.filter(F.col("tokens").isNotNull()).select("tokens").distinct()
    tokens = tokens.filter(~whole_number(F.col("tokens"))).select("tokens", F.lit("invalid_value").alias("tokens_reason"))
    texts = sound.filter(F.col("metadata").isNotNull()).select("metadata").distinct()
    texts = texts.mapInArrow(_judge_objects, "metadata string").select("metadata", F.lit("invalid_value").alias("metadata_reason"))
    return tokens, texts


def judged(parsed: DataFrame) -> DataFrame:
    """parsed with the first reason that holds, null for valid rows."""
    tokens, texts = invalid_values(parsed)
    rows = lookup_join(lookup_join(parsed, tokens, "tokens"), texts, "metadata")
    reason = F.coalesce("structural", "tokens_reason", "metadata_reason")
    return rows.withColumn("reason", reason).drop("structural", "tokens_reason", "metadata_reason")


def quarantine(df: DataFrame, record_id: Column, layout: Column, raw: Column) -> DataFrame:
    """(record_id, reason) of the rows that fail."""
    return judged(parse(df, record_id, layout, raw)).filter(F.col("reason").isNotNull()).select("record_id", "reason")


def load_valid(df: DataFrame, record_id: Column, layout: Column, raw: Column) -> DataFrame:
    """The valid rows with the fields of all layouts in typed columns, null where a layout has no such field."""
    good = judged(parse(df, record_id, layout, raw)).filter(F.col("reason").isNull())
    number = lambda c: F.when(whole_number(F.col(c)), F.trim(c).cast("bigint"))
    return good.select(
        "record_id", "layout", "session_id", "event_time", "model", F.coalesce(number("tokens"), number("input_tokens")).alias("input_tokens"), number("output_tokens").alias("output_tokens"),
        "message_id", "role", "provider", "type", "payload_type", number("cache_read_tokens").alias("cache_read_tokens"), number("cache_write_tokens").alias("cache_write_tokens"),
        decimal_number(F.col("cost")).alias("cost"), F.coalesce("metadata_json", "metadata").alias("metadata"),
    )
