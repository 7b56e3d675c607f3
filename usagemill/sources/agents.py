"""One reader per agent: from its files to the canonical usage table.

Each reader takes (spark, path) and gives rows as the agent recorded them, with
the agent's own rule for repeated rows applied. Prices play no part here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagemill.functions.dates import report_date, strict_ms
from usagemill.functions.lenient import embedded, lenient_count, non_empty, sound_elements
from usagemill.functions.names import decoded, display_model, project_of, session_of
from usagemill.operators import cost, dedupe, ordered, relate
from usagemill.schema import conform, total_tokens
from usagemill.session import cut
from usagemill.sources import wire
from usagemill.sources.sqlite import read_table
from usagemill.sources.text import documents, lines, one_source_per_rollout, parent, parsed, recorded_ms, stem

c, lit = F.col, F.lit
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def reader(name: str):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        READERS[name] = f
        return f

    return add


def n(path: str) -> Column:
    """A token count read as text: whole and not negative, else 0."""
    return lenient_count(c(path))


def used(df: DataFrame, cost_only: bool = False) -> DataFrame:
    """Rows with any tokens, or, with cost_only, any cost."""
    some = total_tokens() > 0
    return df.filter(some | (F.coalesce("cost_usd", lit(0.0)) > 0) if cost_only else some)


def dated(df: DataFrame, zone: str = "UTC") -> DataFrame:
    return df.filter(c("ts_ms").isNotNull()).withColumn("date", report_date(c("ts_ms"), zone))


_USAGE = "input_tokens string, output_tokens string, cache_creation_input_tokens string, cache_read_input_tokens string, speed string, cache_creation struct<ephemeral_5m_input_tokens string, ephemeral_1h_input_tokens string>"
_LINE = f"timestamp string, sessionId string, version string, requestId string, costUSD double, isSidechain boolean, isApiErrorMessage boolean, message struct<id string, model string, usage struct<{_USAGE}, iterations array<struct<type string, model string, {_USAGE}>>>>"


def _first_agent_lines(spark: SparkSession, path: str) -> DataFrame:
    """Direct lines, and lines wrapped in progress records, in one form."""
    rows = parsed(lines(spark, path, ['"usage":{'], "*.jsonl"), f"{_LINE}, type string, data struct<message struct<{_LINE}>>", strict=True)
    inner, top = "j.data.message", "j"
    wrapped = c("j.type") == "progress"
    pick = lambda f: F.when(wrapped, F.coalesce(c(f"{inner}.{f}"), c(f"{top}.{f}"))).otherwise(c(f"{top}.{f}")).alias(f)
    return rows.select("src_file", "seq", *[pick(f) for f in ("timestamp", "sessionId", "version", "requestId", "costUSD", "isSidechain", "isApiErrorMessage", "message")])


def valid_line() -> Column:
    """No id that is there and blank, a version of three numbers if any."""
    blank = lambda x: x.isNotNull() & (F.trim(x) == "")
    ok = c("version").isNull() | c("version").rlike(r"^\d+\.\d+\.\d+")
    for x in ("sessionId", "requestId", "message.id", "message.model"):
        ok = ok & ~blank(c(x))
    return ok


@reader("claude")
def claude(spark: SparkSession, path: str) -> DataFrame:
    rows = _first_agent_lines(spark, path).filter(valid_line()).withColumn("ms", strict_ms(c("timestamp"))).filter("ms is not null and message.usage is not null")
    rows = rows.withColumn("parts", F.concat(
        F.array(F.struct(lit("").alias("tail"), c("message.model").alias("model"), c("costUSD").alias("cost"), F.struct(*[c(f"message.usage.{f}").alias(f) for f in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "speed", "cache_creation")]).alias("u"))),
        F.transform(F.filter(F.coalesce("message.usage.iterations", F.array()), lambda x: x["type"] == "advisor_message"), lambda x, i: F.struct(
            F.concat(lit(":advisor:"), i.cast("string")).alias("tail"), F.coalesce(x["model"], c("message.model")).alias("model"), lit(None).cast("double").alias("cost"),
            F.struct(*[x[f].alias(f) for f in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "speed", "cache_creation")]).alias("u"))),
    ))
    rows = rows.select("*", F.explode("parts").alias("p"))
    split = "p.u.cache_creation"
    none = lambda x: F.when(c(split).isNotNull(), n(f"{split}.{x}"))
    out = conform(
        rows, "claude", session_id=F.coalesce("sessionId", session_of(c("src_file"))), project=project_of(c("src_file")), message_id=F.concat(c("message.id"), c("p.tail")), request_id=c("requestId"), ts_ms=c("ms"),
        model=display_model(c("p.model")), input_tokens=n("p.u.input_tokens"), output_tokens=n("p.u.output_tokens"),
        cache_creation_tokens=cost.cache_created(n("p.u.cache_creation_input_tokens"), none("ephemeral_5m_input_tokens"), none("ephemeral_1h_input_tokens")), cache_1h_tokens=none("ephemeral_1h_input_tokens"),
        cache_read_tokens=n("p.u.cache_read_input_tokens"), speed=c("p.u.speed"), cost_usd=c("p.cost"), version=c("version"), is_sidechain=c("isSidechain"), src_file=c("src_file"), seq=c("seq"),
    )
    return dated(dedupe.without_replays(out))


def limit_resets(spark: SparkSession, path: str) -> DataFrame:
    """(src_file, seq, reset_s): when a usage limit ends, from API error lines."""
    rows = lines(spark, path, ["usage limit reached"], "*.jsonl")
    found = F.regexp_extract("raw", r"usage limit reached\|(\d{1,18})", 1)
    return rows.filter(F.get_json_object("raw", "$.isApiErrorMessage") == "true").select("src_file", "seq", F.nullif(found, lit("")).cast("bigint").alias("reset_s")).filter("reset_s is not null")


_TOKENS = "input_tokens string, prompt_tokens string, input string, output_tokens string, completion_tokens string, output string, cached_input_tokens string, cache_read_input_tokens string, cached_tokens string, cache_write_input_tokens string, cache_creation_input_tokens string, total_tokens string"
_RECORD = f"timestamp string, type string, payload struct<id string, type string, forked_from_id string, model string, model_name string, metadata struct<model string>, response_id string, compaction_response_id string, usage struct<{_TOKENS}>, info struct<model string, model_name string, last_token_usage struct<{_TOKENS}>, total_token_usage struct<{_TOKENS}>>, thread_settings struct<service_tier string>>"


def _spellings(at: str) -> Column:
    """(input, cached, created, output, total) of a usage object, whatever the fields are called."""
    pick = lambda *names: lenient_count(F.coalesce(*[c(f"{at}.{x}") for x in names]))
    i = pick("input_tokens", "prompt_tokens", "input")
    cached, created = cost.clamped(i, pick("cached_input_tokens", "cache_read_input_tokens", "cached_tokens"), pick("cache_write_input_tokens", "cache_creation_input_tokens"))
    o = pick("output_tokens", "completion_tokens", "output")
    t = pick("total_tokens")
    return F.struct(i.alias("i"), cached.alias("r"), created.alias("w"), o.alias("o"), F.when(t > 0, t).otherwise(i + o).alias("t"))


@reader("codex")
def codex(spark: SparkSession, path: str) -> DataFrame:
    """Running totals become usage, forks lose what they replay, compactions count once."""
    raw = one_source_per_rollout(lines(spark, path, ["session_meta", "turn_context", "token_count", "thread_settings", "token_usage_record", "compacted"]))
    rows = parsed(raw, _RECORD).withColumn("ms", recorded_ms(c("j.timestamp")))
    named = F.coalesce("j.payload.model", "j.payload.model_name", "j.payload.metadata.model", "j.payload.info.model", "j.payload.info.model_name")
    rows = ordered.carry_forward(rows.withColumn("named", named), ["src_file"], ["seq"], "named", "model")
    settings = c("j.payload.thread_settings")
    rows = ordered.carry_known(rows, ["src_file"], ["seq"], settings.isNotNull() & settings["service_tier"].isNotNull(), F.when(settings["service_tier"].isin("standard", "default", "fast", "priority", "flex"), settings["service_tier"]), "tier")
    head = rows.filter("j.type = 'session_meta'").groupBy("src_file").agg(F.min_by(F.struct(c("j.payload.id").alias("id"), c("j.payload.forked_from_id").alias("up"), c("ms").alias("start")), "seq").alias("h"))
    head = head.select("src_file", "h.*")
    counts = rows.filter("j.payload.type = 'token_count' and j.payload.info is not null")
    counts = counts.withColumn("now", _spellings("j.payload.info.total_token_usage")).withColumn("last", _spellings("j.payload.info.last_token_usage"))
    w = Window.partitionBy("src_file").orderBy("seq")
    before = F.lag("now").over(w)
    has_total, has_last = c("j.payload.info.total_token_usage").isNotNull(), c("j.payload.info.last_token_usage").isNotNull()
    rise = F.struct(*[F.greatest(c(f"now.{k}") - F.coalesce(before[k], lit(0)), lit(0)).alias(k) for k in "irwot"])
    advanced = ~has_total | before.isNull() | (c("now.t") != before["t"])
    usage = F.when(has_last & advanced, c("last")).when(has_total & advanced, rise)
    counts = counts.withColumn("u", usage).filter("u is not null and (u.i > 0 or u.o > 0)").withColumn("rid", lit(None).cast("string"))
    records = rows.filter("j.type = 'token_usage_record' and j.payload.usage is not null").withColumn("u", _spellings("j.payload.usage")).withColumn("rid", non_empty(c("j.payload.response_id")))
    compacted = rows.filter("j.type = 'compacted'").select(non_empty(c("j.payload.compaction_response_id")).alias("rid")).filter("rid is not null").distinct()
    records = records.join(compacted, "rid", "left_semi").filter("u.i > 0 or u.o > 0")
    events = counts.select("src_file", "seq", "ms", "model", "tier", "rid", "u").unionByName(records.select("src_file", "seq", "ms", "model", "tier", "rid", "u"))
    events = events.join(head, "src_file", "left")
    # The content ahead of a fork's own work repeats its parent's, row by row.
    content = F.to_json("u")
    parents = events.filter("rid is null").select(c("id").alias("up"), "seq", content.alias("x"))
    kids = events.filter("up is not null and rid is null").withColumn("x", content)
    pairs = kids.select("src_file", "up").distinct().join(parents, "up").select("src_file", "seq", "x")
    replay = relate.replayed_prefix(kids.select("src_file", "seq", "x"), pairs, "src_file", "seq", "x")
    kids = kids.join(replay.select("src_file", "seq", "replayed"), ["src_file", "seq"])
    burst = ordered.leading_burst(kids, ["src_file"], ["seq"], "ms", "start")
    matched = F.max(c("replayed").cast("int")).over(Window.partitionBy("src_file")) == 1
    own = burst.withColumn("matched", matched).filter((c("matched") & ~c("replayed")) | (~c("matched") & ~F.coalesce("in_burst", lit(False))))
    kept = events.filter("up is null or rid is not null").unionByName(own.select(events.columns))
    kept = kept.withColumn("key", F.concat_ws("|", "ms", F.coalesce("model", lit("~")), content))
    named_once = dedupe.keep_first(kept.filter("rid is not null"), [c("rid")], "seq")
    kept = dedupe.across_files(kept.filter("rid is null"), ["key"], "src_file", "seq").drop("occurrence").unionByName(named_once)
    out = conform(
        kept, "codex", session_id=stem(), message_id=c("rid"), ts_ms=c("ms"), model=c("model"), input_tokens=c("u.i") - c("u.r") - c("u.w"), output_tokens=c("u.o"),
        cache_creation_tokens=c("u.w"), cache_read_tokens=c("u.r"), speed=F.when(c("tier").isin("fast", "priority"), "fast"), src_file=c("src_file"), seq=c("seq"),
    )
    return dated(out)


@reader("copilot")
def copilot(spark: SparkSession, path: str) -> DataFrame:
    """Cumulative session snapshots as intervals, and spans later than the last snapshot."""
    shut = parsed(lines(spark, path, ["session.shutdown"], "events.jsonl"), "type string, id string, timestamp string, data struct<modelMetrics map<string, struct<usage struct<inputTokens string, outputTokens string, cacheReadTokens string, cacheWriteTokens string>, requests struct<count string>, totalNanoAiu string>>>")
    shots = shut.select("src_file", "seq", recorded_ms(c("j.timestamp")).alias("ms"), parent("src_file").alias("session"), c("j.id").alias("id"), F.explode("j.data.modelMetrics").alias("model", "m"))
    names = {"i": "usage.inputTokens", "o": "usage.outputTokens", "r": "usage.cacheReadTokens", "w": "usage.cacheWriteTokens", "calls": "requests.count", "nano": "totalNanoAiu"}
    shots = dedupe.keep_best(shots.select("src_file", "seq", "ms", "session", "id", "model", *[n(f"m.{p}").alias(k) for k, p in names.items()]), [c("session"), c("model"), F.coalesce("id", c("seq").cast("string"))], [c("ms"), c("seq")])
    spans = ordered.cumulative_to_delta(shots, ["session", "model"], ["ms", "seq"], list(names))
    cached = F.least("delta_r", "delta_i")
    intervals = conform(
        spans, "copilot", session_id=c("session"), ts_ms=c("ms"), model=_plain_model("model"), input_tokens=c("delta_i") - cached, output_tokens=c("delta_o"), cache_read_tokens=cached, cache_creation_tokens=c("delta_w"),
        credits=c("delta_nano") / 1e9, message_count=c("delta_calls"), src_file=c("src_file"), seq=c("seq"),
    )
    attr = ["gen_ai.operation.name", "gen_ai.response.model", "gen_ai.request.model", "gen_ai.conversation.id", "gen_ai.response.id", "gen_ai.usage.input_tokens", "gen_ai.usage.output_tokens", "gen_ai.usage.cache_read.input_tokens", "event.name"]
    otel = parsed(lines(spark, path, ["gen_ai."], "*.jsonl"), "type string, traceId string, spanId string, name string, endTime array<bigint>, body string, attributes map<string, string>")
    a = lambda k: F.try_element_at(c("j.attributes"), lit(k))
    op, span = a(attr[0]), c("j.type") == "span"
    tier = F.when(span & ((op == "chat") | c("j.name").startswith("chat ")), 0).when(~span & ((a(attr[8]) == "gen_ai.client.inference.operation.details") | c("j.body").startswith("GenAI inference:")), 1).when(~span & (a(attr[8]) == "copilot_chat.agent.turn"), 2).when(span & (op == "invoke_agent"), 3)
    calls = otel.select("src_file", "seq", tier.alias("tier"), c("j.traceId").alias("trace"), a(attr[4]).alias("response"), a(attr[3]).alias("session"), F.coalesce(a(attr[1]), a(attr[2])).alias("model"), (c("j.endTime")[0] * 1000 + F.floor(c("j.endTime")[1] / 1e6)).cast("bigint").alias("ms"), *[lenient_count(a(k)).alias(x) for x, k in (("i", attr[5]), ("o", attr[6]), ("r", attr[7]))])
    calls = calls.filter("tier is not null")
    best = relate.precedence([calls.filter(c("tier") == t) for t in range(4)], ["trace", "response"])
    best = dedupe.keep_best(best.withColumn("one", F.coalesce("response", F.concat_ws("/", "trace", c("seq").cast("string")))), [c("one"), F.coalesce("model", lit("")), c("i"), c("o"), c("r")], [-c("ms"), -c("seq")])
    cutoffs = shots.groupBy("session").agg(F.max("ms").alias("cutoff"))
    late = relate.after_cutoff(best, cutoffs, ["session"], "ms", "cutoff")
    cached = F.least("r", "i")
    calls = conform(late, "copilot", session_id=c("session"), message_id=c("response"), ts_ms=c("ms"), model=_plain_model("model"), input_tokens=c("i") - cached, output_tokens=c("o"), cache_read_tokens=cached, message_count=lit(1), src_file=c("src_file"), seq=c("seq"))
    return dated(intervals.filter((total_tokens() > 0) | (c("credits") > 0)).unionByName(used(calls)))


def _plain_model(name: str) -> Column:
    return F.regexp_replace(name, r"-1m(?:-internal)?$", "")


_GEMINI = {
    "input": ("input", "prompt", "input_tokens", "prompt_tokens"), "output": ("output", "candidates", "output_tokens", "candidates_tokens"), "cached": ("cached", "cached_tokens"),
    "thoughts": ("thoughts", "reasoning", "thoughts_tokens", "reasoning_tokens"), "tool": ("tool", "tool_tokens"), "total": ("total", "total_tokens"),
}
_GEMINI_TOKENS = ", ".join(f"{x} string" for names in _GEMINI.values() for x in names)
_GEMINI_RECORD = "sessionId string, session_id string, projectHash string, id string, timestamp string, created_at string, startTime string, lastUpdated string, type string, model string, messages string, tokens string, stats string, result string"


def _gemini_counts(tokens: Column) -> dict[str, Column]:
    """The counters of a token object, whatever they are called; fractions are cut off."""

    def count(x: Column) -> Column:
        d = x.try_cast("double")
        return F.when(d.isNotNull() & ~F.isnan(d), F.greatest(lenient_count(x), F.when(d.between(0, 9e18), d.cast("bigint"))))

    return {k: F.coalesce(*[count(tokens[x]) for x in names], lit(0).cast("bigint")) for k, names in _GEMINI.items()}


def _gemini_stats(df: DataFrame, hint: Column) -> DataFrame:
    """df with a row (model, t) for each model of stats or result.stats, or one for all of it if no model has usage."""
    # As one text first: a part of another shape then costs that part alone.
    text = F.coalesce("j.stats", F.get_json_object("j.result", "$.stats"))
    s = df.filter(text.startswith("{")).withColumn("s", embedded(text, f"models string, {_GEMINI_TOKENS}")).withColumn("hint", hint)
    models = F.transform(F.map_entries(embedded(c("s.models"), "map<string, string>")), lambda e: F.struct(e["key"].alias("model"), embedded(F.get_json_object(e["value"], "$.tokens"), _GEMINI_TOKENS).alias("t")))
    some = lambda e: (F.trim(e["model"]) != "") & (F.greatest(*_gemini_counts(e["t"]).values()) > 0)
    alone = F.array(F.struct(F.coalesce("hint", lit("unknown")).alias("model"), F.struct(*[c(f"s.{x.split()[0]}").alias(x.split()[0]) for x in _GEMINI_TOKENS.split(", ")]).alias("t")))
    per = s.withColumn("per", F.filter(models, some))
    return per.select("*", F.explode(F.when(F.size("per") > 0, c("per")).otherwise(alone)).alias("e")).withColumn("model", c("e.model")).withColumn("t", c("e.t"))


@reader("gemini")
def gemini(spark: SparkSession, path: str) -> DataFrame:
    """Messages of chats, single records, and stats of a session per model or in one."""
    rows = parsed(lines(spark, path, ["sessionId", "session_id", '"tokens"', '"stats"', '"model"'], "*.jsonl"), _GEMINI_RECORD)
    for name, value in (("session", F.coalesce(non_empty(c("j.sessionId")), non_empty(c("j.session_id")))), ("project", c("j.projectHash")), ("model", non_empty(c("j.model")))):
        rows = ordered.carry_forward(rows.withColumn("_new", value), ["src_file"], ["seq"], "_new", name).drop("_new")
    whole = parsed(documents(spark, path, "*.json"), _GEMINI_RECORD).withColumn("session", F.coalesce(non_empty(c("j.sessionId")), non_empty(c("j.session_id")))).withColumn("project", c("j.projectHash")).withColumn("model", non_empty(c("j.model")))
    chat, direct = F.coalesce(F.ltrim("j.messages").startswith("["), lit(False)), F.coalesce(c("j.type") == "gemini", lit(False))
    said = whole.filter(chat).drop("seq").select("*", F.posexplode(sound_elements(c("j.messages"), "id string, timestamp string, created_at string, type string, model string, tokens string")).alias("seq", "m")).filter("m.type = 'gemini' and m.tokens is not null")
    said = said.withColumn("model", c("m.model"))
    mtime = F.unix_millis("modified_at")
    at = lambda *names: F.coalesce(*[recorded_ms(c(x)) for x in names], mtime)
    shape = lambda df, ident, ms, overlap: df.select("src_file", c("seq").cast("bigint").alias("seq"), "session", "project", ident.alias("id"), ms.alias("ms"), "model", "t", lit(overlap).alias("overlap"))
    record = lambda df: df.filter(direct & c("j.tokens").isNotNull()).withColumn("t", embedded(c("j.tokens"), _GEMINI_TOKENS))
    messages = shape(said.withColumn("t", embedded(c("m.tokens"), _GEMINI_TOKENS)), c("m.id"), at("m.timestamp", "m.created_at", "j.startTime", "j.lastUpdated"), False)
    for df in (record(rows), record(whole.filter(~chat))):
        messages = messages.unionByName(shape(df, c("j.id"), at("j.timestamp", "j.created_at"), False))
    union = dedupe.keep_last(messages, [c("src_file"), c("id")], "seq")
    for df in (rows.filter(~direct), whole.filter(~chat & ~direct)):
        union = union.unionByName(shape(_gemini_stats(df, c("model")), lit(None).cast("string"), at("j.timestamp"), True))
    k = _gemini_counts(c("t"))
    i, cached = k["input"] + k["tool"], k["cached"]
    # The input of stats includes the cached part; that of messages only where their total says so.
    inside = c("overlap") | (k["total"] == i + k["output"] + k["thoughts"])
    fresh = F.when(inside, F.when(c("overlap"), F.greatest(k["input"] - cached, lit(0)) + k["tool"]).otherwise(F.greatest(i - cached, lit(0)))).otherwise(i)
    o, extra = cost.fill_total(k["output"], lit(0).cast("bigint"), fresh + k["output"] + cached + k["thoughts"], k["total"])
    return dated(used(conform(union, "gemini", session_id=F.coalesce("session", stem()), project=c("project"), message_id=c("id"), ts_ms=c("ms"), model=c("model"), input_tokens=fresh, output_tokens=o + k["thoughts"], extra_total_tokens=extra, cache_read_tokens=cached, src_file=c("src_file"), seq=c("seq"))))


@reader("qwen")
def qwen(spark: SparkSession, path: str) -> DataFrame:
    rows = parsed(lines(spark, path, ['"usageMetadata"'], "*.jsonl"), "type string, id string, timestamp string, sessionId string, model string, usageMetadata struct<promptTokenCount string, candidatesTokenCount string, thoughtsTokenCount string, cachedContentTokenCount string, totalTokenCount string>")
    u = "j.usageMetadata"
    i, cached = n(f"{u}.promptTokenCount"), n(f"{u}.cachedContentTokenCount")
    session = F.coalesce(non_empty(c("j.sessionId")), F.concat_ws("-", project_of(c("src_file")), stem()))
    o, extra = cost.fill_total(n(f"{u}.candidatesTokenCount") + n(f"{u}.thoughtsTokenCount"), lit(0).cast("bigint"), i + n(f"{u}.candidatesTokenCount") + n(f"{u}.thoughtsTokenCount"), n(f"{u}.totalTokenCount"))
    out = conform(rows.filter("j.type = 'assistant'"), "qwen", session_id=session, project=project_of(c("src_file")), message_id=c("j.id"), ts_ms=recorded_ms(c("j.timestamp")), model=c("j.model"), input_tokens=F.greatest(i - cached, lit(0)), output_tokens=o, extra_total_tokens=extra, cache_read_tokens=cached, src_file=c("src_file"), seq=c("seq"))
    return dated(used(dedupe.keep_first(out, [dedupe.content_key("session_id", "message_id", "ts_ms", "model", "input_tokens", "output_tokens", "cache_read_tokens")], "seq")))


@reader("kimi")
def kimi(spark: SparkSession, path: str) -> DataFrame:
    """Old status updates, and new records of one turn; records of a whole session are running sums."""
    rows = parsed(lines(spark, path, ["StatusUpdate", "usage.record"], "*.jsonl"), "timestamp string, type string, usageScope string, time string, model string, usage struct<inputOther string, output string, inputCacheRead string, inputCacheCreation string>, message struct<type string, payload struct<message_id string, token_usage struct<input_other string, output string, input_cache_read string, input_cache_creation string, total string>>>")
    new, old = c("j.type") == "usage.record", c("j.message.type") == "StatusUpdate"
    p, q = "j.usage", "j.message.payload.token_usage"
    pick = lambda a, b: F.when(new, n(f"{p}.{a}")).otherwise(n(f"{q}.{b}"))
    rows = rows.filter((new & (c("j.usageScope") == "turn")) | (old & c(q).isNotNull()))
    out = conform(rows, "kimi", session_id=parent("src_file"), message_id=c("j.message.payload.message_id"), ts_ms=recorded_ms(F.coalesce("j.time", "j.timestamp")), model=c("j.model"), input_tokens=pick("inputOther", "input_other"), output_tokens=pick("output", "output"), cache_read_tokens=pick("inputCacheRead", "input_cache_read"), cache_creation_tokens=pick("inputCacheCreation", "input_cache_creation"), src_file=c("src_file"), seq=c("seq"))
    return dated(used(dedupe.keep_first(out, [dedupe.content_key("session_id", "message_id", "ts_ms", "model", *("input_tokens", "output_tokens", "cache_read_tokens"))], "seq")))


@reader("grok")
def grok(spark: SparkSession, path: str) -> DataFrame:
    one = "inputTokens string, outputTokens string, cachedReadTokens string, cacheCreationTokens string, reasoningTokens string, totalTokens string, costUsdTicks string"
    rows = parsed(lines(spark, path, ["turn_completed"], "updates.jsonl"), f"params struct<sessionId string, _meta struct<eventId string, timestamp string>, update struct<sessionUpdate string, usage struct<{one}, modelUsage map<string, struct<{one}>>>>>")
    rows = rows.filter("j.params.update.sessionUpdate = 'turn_completed'").withColumn("u", c("j.params.update.usage"))
    per = F.when(F.size("u.modelUsage") > 0, F.transform(F.map_entries("u.modelUsage"), lambda e: F.struct(e["key"].alias("model"), e["value"].alias("v"))))
    alone = F.array(F.struct(lit(None).cast("string").alias("model"), F.struct(*[c(f"u.{x.split()[0]}").alias(x.split()[0]) for x in one.split(", ")]).alias("v")))
    rows = rows.select("src_file", "seq", "modified_at", "j", F.explode(F.coalesce(per, alone)).alias("m"))
    summary = parsed(documents(spark, path, "summary.json"), "title string, model string, cwd string, updatedAt string").select(parent("src_file").alias("folder"), c("j.model").alias("s_model"), c("j.cwd").alias("s_cwd"), recorded_ms(c("j.updatedAt")).alias("s_ms"))
    rows = rows.withColumn("folder", parent("src_file")).join(summary.dropDuplicates(["folder"]), "folder", "left")
    i = n("m.v.inputTokens")
    cached, created = cost.clamped(i, n("m.v.cachedReadTokens"), n("m.v.cacheCreationTokens"))
    when = F.coalesce(recorded_ms(c("j.params._meta.timestamp")), c("s_ms"), F.unix_millis("modified_at"))
    out = conform(rows, "grok", session_id=F.coalesce("j.params.sessionId", "folder"), project=decoded(c("s_cwd")), message_id=c("j.params._meta.eventId"), ts_ms=when, model=F.coalesce("m.model", "s_model"), input_tokens=i - cached - created, output_tokens=n("m.v.outputTokens"), cache_read_tokens=cached, cache_creation_tokens=created, cost_usd=F.when(n("m.v.costUsdTicks") > 0, n("m.v.costUsdTicks") / 1e10), src_file=c("src_file"), seq=c("seq"))
    return dated(used(dedupe.keep_first(out, [dedupe.content_key("session_id", "message_id", "model", "input_tokens", "output_tokens", "cache_read_tokens")], "seq")))


@reader("pi")
def pi(spark: SparkSession, path: str) -> DataFrame:
    """Messages of sessions; a fork's copy of its parent's messages goes to the parent."""
    rows = parsed(lines(spark, path, ['"session"', '"usage"'], "*.jsonl").filter(~c("src_file").contains("/subagent-artifacts/")), "type string, id string, parentId string, parentSession string, timestamp string, cwd string, message struct<role string, model string, provider string, usage struct<input string, output string, cacheRead string, cacheWrite string, totalTokens string, cost struct<total double>>>")
    head = rows.filter("j.type = 'session'").groupBy("src_file").agg(F.min_by(F.struct(c("j.id").alias("session"), c("j.parentSession").alias("up"), c("j.cwd").alias("cwd")), "seq").alias("h")).select("src_file", "h.*")
    said = rows.filter("j.type = 'message' and j.message.role = 'assistant' and j.message.usage is not null").join(head, "src_file", "left")
    u = "j.message.usage"
    out = conform(said, "pi", session_id=F.coalesce("session", stem()), project=c("cwd"), message_id=c("j.id"), ts_ms=recorded_ms(c("j.timestamp")), model=c("j.message.model"), provider=c("j.message.provider"), input_tokens=n(f"{u}.input"), output_tokens=n(f"{u}.output"), cache_read_tokens=n(f"{u}.cacheRead"), cache_creation_tokens=n(f"{u}.cacheWrite"), cost_usd=c(f"{u}.cost.total"), src_file=c("src_file"), seq=c("seq"))
    keyed = out.join(head.select("src_file", c("up").isNotNull().alias("fork")), "src_file", "left")
    key = dedupe.content_key("message_id", "ts_ms", "model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
    return dated(used(dedupe.keep_best(keyed, [key], [~F.coalesce("fork", lit(False)), -c("seq")]).drop("fork").select(out.columns), cost_only=True))


@reader("openclaw")
def openclaw(spark: SparkSession, path: str) -> DataFrame:
    """Session files and per-agent databases; a database's row replaces the file's."""
    schema = "type string, id string, provider string, modelId string, message struct<role string, timestamp string, usage struct<input string, output string, cacheRead string, cacheWrite string, totalTokens string, cost struct<total double>>>"
    files = parsed(lines(spark, path, ["model_change", '"usage"'], "*.jsonl"), schema).select("src_file", "seq", "j", stem().alias("session"))
    table = read_table(spark, path, "transcript_events", "session_id string, seq bigint, event_json string, src_file string")
    rows = parsed(table.withColumnRenamed("event_json", "raw").withColumn("modified_at", lit(None).cast("timestamp")), schema).select("src_file", "seq", "j", c("session_id").alias("session"))
    parts = []
    for df in (rows, files):
        df = ordered.carry_forward(df.withColumn("change", F.when(c("j.type") == "model_change", c("j.modelId"))), ["src_file", "session"], ["seq"], "change", "model").filter("j.type = 'message' and j.message.usage is not null")
        u = "j.message.usage"
        parts.append(conform(df, "openclaw", session_id=c("session"), message_id=c("j.id"), ts_ms=recorded_ms(c("j.message.timestamp")), model=c("model"), input_tokens=n(f"{u}.input"), output_tokens=n(f"{u}.output"), cache_read_tokens=n(f"{u}.cacheRead"), cache_creation_tokens=n(f"{u}.cacheWrite"), cost_usd=c(f"{u}.cost.total"), src_file=c("src_file"), seq=c("seq")))
    return dated(used(dedupe.with_priority(parts, [F.coalesce(F.concat(lit("i:"), non_empty(c("message_id"))), dedupe.content_key("ts_ms", "model", "input_tokens", "output_tokens"))], "seq")))


@reader("amp")
def amp(spark: SparkSession, path: str) -> DataFrame:
    """Ledger events, with cache counts of the message they lead to; messages where there's no ledger."""
    rows = parsed(documents(spark, path, "*.json"), "id string, messages array<struct<role string, messageId string, timestamp string, usage struct<model string, inputTokens string, outputTokens string, cacheReadInputTokens string, cacheCreationInputTokens string, timestamp string, credits double>>>, usageLedger struct<events array<struct<id string, timestamp string, model string, credits double, tokens struct<input string, output string, total string>, toMessageId string>>>")
    has = F.coalesce(F.size("j.usageLedger.events") > 0, lit(False))
    said = rows.select("src_file", "j", has.alias("has"), F.posexplode("j.messages").alias("seq", "m"))
    cache = said.select("src_file", c("m.messageId").alias("to"), n("m.usage.cacheReadInputTokens").alias("r"), n("m.usage.cacheCreationInputTokens").alias("w")).filter("to is not null").dropDuplicates(["src_file", "to"])
    events = rows.filter(has).select("src_file", c("j.id").alias("id"), F.posexplode("j.usageLedger.events").alias("seq", "e")).withColumn("to", c("e.toMessageId")).join(cache, ["src_file", "to"], "left")
    o, extra = cost.fill_total(n("e.tokens.output"), lit(0).cast("bigint"), n("e.tokens.input") + n("e.tokens.output"), n("e.tokens.total"))
    a = conform(events, "amp", session_id=c("id"), message_id=c("e.id"), ts_ms=recorded_ms(c("e.timestamp")), model=c("e.model"), input_tokens=n("e.tokens.input"), output_tokens=o, extra_total_tokens=extra, cache_read_tokens=c("r"), cache_creation_tokens=c("w"), credits=c("e.credits"), src_file=c("src_file"), seq=c("seq"))
    alone = said.filter(~c("has") & c("m.usage").isNotNull())
    b = conform(alone, "amp", session_id=c("j.id"), message_id=c("m.messageId"), ts_ms=recorded_ms(F.coalesce("m.usage.timestamp", "m.timestamp")), model=c("m.usage.model"), input_tokens=n("m.usage.inputTokens"), output_tokens=n("m.usage.outputTokens"), cache_read_tokens=n("m.usage.cacheReadInputTokens"), cache_creation_tokens=n("m.usage.cacheCreationInputTokens"), credits=c("m.usage.credits"), src_file=c("src_file"), seq=c("seq"))
    return dated(used(a.unionByName(b)))


@reader("droid")
def droid(spark: SparkSession, path: str) -> DataFrame:
    """A session's settings; the model comes from the log beside it if they don't name one."""
    rows = parsed(documents(spark, path, "*.settings.json"), "model string, providerLock string, providerLockTimestamp string, tokenUsage struct<inputTokens string, outputTokens string, cacheCreationTokens string, cacheReadTokens string, thinkingTokens string, totalTokens string>")
    rows = rows.withColumn("id", F.regexp_extract("src_file", r"([^/]+)\.settings\.json$", 1))
    beside = lines(spark, path, ['"model"'], "*.jsonl").select(stem().alias("id"), "seq", F.regexp_extract("raw", r'"model"\s*:\s*"([^"]+)"', 1).alias("m")).filter("m <> ''").groupBy("id").agg(F.min_by("m", "seq").alias("beside"))
    rows = rows.join(beside, "id", "left")
    u = "j.tokenUsage"
    known = n(f"{u}.inputTokens") + n(f"{u}.outputTokens") + n(f"{u}.cacheCreationTokens") + n(f"{u}.cacheReadTokens") + n(f"{u}.thinkingTokens")
    o, extra = cost.fill_total(n(f"{u}.outputTokens") + n(f"{u}.thinkingTokens"), lit(0).cast("bigint"), known, n(f"{u}.totalTokens"))
    when = F.coalesce(recorded_ms(c("j.providerLockTimestamp")), F.unix_millis("modified_at"))
    return dated(used(conform(rows, "droid", session_id=c("id"), ts_ms=when, model=F.coalesce(non_empty(c("j.model")), c("beside")), provider=c("j.providerLock"), input_tokens=n(f"{u}.inputTokens"), output_tokens=o, extra_total_tokens=extra, cache_creation_tokens=n(f"{u}.cacheCreationTokens"), cache_read_tokens=n(f"{u}.cacheReadTokens"), src_file=c("src_file"), seq=c("seq"))))


@reader("codebuff")
def codebuff(spark: SparkSession, path: str) -> DataFrame:
    usage = "usage struct<inputTokens string, input_tokens string, outputTokens string, output_tokens string, cacheReadTokens string, cache_read_input_tokens string, cacheCreationTokens string, cache_creation_input_tokens string>"
    rows = documents(spark, path, "chat-messages.json").withColumn("j", F.from_json("raw", f"array<struct<id string, variant string, role string, timestamp string, credits double, metadata struct<model string, timestamp string, {usage}, codebuff struct<model string, {usage}>>>>")).filter("j is not null")
    rows = rows.select("src_file", "modified_at", F.posexplode("j").alias("seq", "m")).filter("m.variant in ('ai', 'assistant', 'agent') or m.role = 'assistant'")
    spelled = lambda *names: lenient_count(F.coalesce(*[c(f"m.metadata.{at}.{x}") for at in ("usage", "codebuff.usage") for x in names]))
    out = conform(rows, "codebuff", session_id=F.concat_ws("/", parent("src_file", 3), parent("src_file", 2), parent("src_file")), project=parent("src_file", 2), message_id=c("m.id"), ts_ms=F.coalesce(recorded_ms(F.coalesce("m.timestamp", "m.metadata.timestamp")), F.unix_millis("modified_at")), model=F.coalesce("m.metadata.model", "m.metadata.codebuff.model"), input_tokens=spelled("inputTokens", "input_tokens"), output_tokens=spelled("outputTokens", "output_tokens"), cache_read_tokens=spelled("cacheReadTokens", "cache_read_input_tokens"), cache_creation_tokens=spelled("cacheCreationTokens", "cache_creation_input_tokens"), credits=c("m.credits"), src_file=c("src_file"), seq=c("seq"))
    return dated(used(dedupe.keep_first(out, [dedupe.content_key("session_id", "message_id", "ts_ms", "model", "input_tokens", "output_tokens")], "seq")))


@reader("cline")
def cline(spark: SparkSession, path: str) -> DataFrame:
    """The extension's messages, which hold JSON in a string, and the command line's sessions."""
    ext = documents(spark, path, "ui_messages.json").withColumn("j", F.from_json("raw", "array<struct<ts string, type string, say string, partial boolean, text string, modelInfo struct<modelId string, providerId string>>>")).filter("j is not null")
    ext = ext.select("src_file", F.posexplode("j").alias("seq", "m")).filter("m.say = 'api_req_started' and not coalesce(m.partial, false)").withColumn("t", embedded(c("m.text"), "tokensIn string, tokensOut string, cacheReads string, cacheWrites string, cost double"))
    a = conform(ext, "cline", session_id=parent("src_file"), ts_ms=recorded_ms(c("m.ts")), model=F.nullif(c("m.modelInfo.modelId"), lit("unknown")), provider=c("m.modelInfo.providerId"), input_tokens=n("t.tokensIn"), output_tokens=n("t.tokensOut"), cache_read_tokens=n("t.cacheReads"), cache_creation_tokens=n("t.cacheWrites"), cost_usd=c("t.cost"), src_file=c("src_file"), seq=c("seq"))
    cli = parsed(documents(spark, path, "*.messages.json"), "sessionId string, messages array<struct<id string, role string, ts string, timestamp string, modelInfo struct<id string, provider string>, metrics struct<inputTokens string, outputTokens string, cacheReadTokens string, cacheWriteTokens string, cost double>>>")
    cli = cli.select("src_file", "j", F.posexplode("j.messages").alias("seq", "m")).filter("m.metrics is not null")
    b = conform(cli, "cline", session_id=c("j.sessionId"), message_id=c("m.id"), ts_ms=recorded_ms(F.coalesce("m.ts", "m.timestamp")), model=F.nullif(c("m.modelInfo.id"), lit("unknown")), provider=c("m.modelInfo.provider"), input_tokens=n("m.metrics.inputTokens"), output_tokens=n("m.metrics.outputTokens"), cache_read_tokens=n("m.metrics.cacheReadTokens"), cache_creation_tokens=n("m.metrics.cacheWriteTokens"), cost_usd=c("m.metrics.cost"), src_file=c("src_file"), seq=c("seq"))
    return dated(used(a.unionByName(b), cost_only=True))


_MESSAGE = "id string, sessionID string, role string, providerID string, modelID string, model string, status string, time struct<created string, completed string>, tokens struct<input string, output string, reasoning string, total string, cache struct<read string, write string>>, cost double"


def _open_message(df: DataFrame, agent: str, session: Column, ident: Column, when: Column) -> DataFrame:
    t, nested = "j.tokens", embedded(c("j.model"), "id string, providerID string, provider_id string")
    o, extra = cost.fill_total(n(f"{t}.output"), n(f"{t}.reasoning"), n(f"{t}.input") + n(f"{t}.output") + n(f"{t}.reasoning") + n(f"{t}.cache.read") + n(f"{t}.cache.write"), n(f"{t}.total"))
    return conform(df, agent, session_id=session, message_id=ident, ts_ms=when, model=F.coalesce(non_empty(nested["id"]), c("j.modelID")), provider=F.coalesce(non_empty(nested["providerID"]), non_empty(nested["provider_id"]), c("j.providerID")), input_tokens=n(f"{t}.input"), output_tokens=o, extra_total_tokens=extra, cache_read_tokens=n(f"{t}.cache.read"), cache_creation_tokens=n(f"{t}.cache.write"), cost_usd=c("j.cost"), src_file=c("src_file"), seq=c("seq"))


def _open_database(spark: SparkSession, path: str, table: str, created: str, more: str = "") -> DataFrame:
    rows = read_table(spark, path, table, f"id string, session_id string, data string, {created} bigint, {more}src_file string").withColumnRenamed("data", "raw").withColumnRenamed("seq", "place")
    rows = rows.withColumn("seq", F.coalesce(c(created), lit(0))).withColumn("modified_at", lit(None).cast("timestamp"))
    return parsed(rows, _MESSAGE).filter("j.tokens is not null")


def _fork_cutoffs(spark: SparkSession, path: str) -> DataFrame:
    """(src_file, session_id, cutoff): the last place of a fork's rows that is its parent's history.

    The boundary names a message of the parent; copies have new ids but keep
    their place. A boundary that can't be found gives no cut-off.
    """
    rows = read_table(spark, path, "session_message", "id string, session_id string, seq bigint, src_file string").filter("seq is not null")
    below = F.max("seq").over(Window.partitionBy("src_file", "session_id").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1))
    marks = rows.select("src_file", c("session_id").alias("up"), c("id").alias("mark"), c("seq").alias("through"), below.alias("before"))
    forks = read_table(spark, path, "session_v2", "id string, fork_session_id string, fork_boundary string, src_file string").withColumn("b", embedded(c("fork_boundary"), "type string, messageID string"))
    forks = forks.select("src_file", c("id").alias("session_id"), c("fork_session_id").alias("up"), c("b.type").alias("side"), c("b.messageID").alias("mark"))
    cutoff = F.when(c("side") == "through", c("through")).when(c("side") == "before", c("before"))
    return forks.join(marks, ["src_file", "up", "mark"]).groupBy("src_file", "session_id").agg(F.min(cutoff).alias("cutoff")).filter("cutoff is not null")


def _open_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Running sums of whole sessions; the older table counts in databases that have session_message."""
    counters = ("input", "output", "reasoning", "cache_read", "cache_write")
    schema = "id string, model string, time_created bigint, cost double, " + ", ".join(f"tokens_{k} bigint" for k in counters) + ", src_file string"
    newer = read_table(spark, path, "sqlite_master", "name string, src_file string").filter("name = 'session_message'").select("src_file").distinct()
    text = non_empty(c("model"))
    v = F.try_parse_json(text)
    at = lambda *names: non_empty(F.coalesce(*[F.try_variant_get(v, f"$.{x}", "string") for x in names]))
    is_object = text.startswith("{") & v.isNotNull()
    named = F.when(is_object, at("id", "modelID")).when(text.startswith('"') & v.isNotNull(), F.coalesce(non_empty(F.try_variant_get(v, "$", "string")), text)).otherwise(text)
    maker = F.when(is_object & named.isNotNull(), at("providerID", "provider"))
    z = lambda k: F.greatest(F.coalesce(c(f"tokens_{k}"), lit(0)), lit(0))
    parts = []
    for df in (read_table(spark, path, "session_v2", schema), read_table(spark, path, "session", schema).join(newer, "src_file", "left_semi")):
        df = df.filter("id is not null")
        parts.append(used(conform(df, "opencode", session_id=c("id"), message_id=F.concat(lit("session:"), c("id")), ts_ms=recorded_ms(c("time_created").cast("string")), model=F.coalesce(named, lit("unknown")), provider=F.coalesce(maker, lit("unknown")), input_tokens=z("input"), output_tokens=z("output"), extra_total_tokens=z("reasoning"), cache_read_tokens=z("cache_read"), cache_creation_tokens=z("cache_write"), cost_usd=c("cost"), src_file=c("src_file"), seq=lit(0)), cost_only=True))
    return dated(dedupe.with_priority(parts, [c("message_id")], "seq"))


@reader("opencode")
def opencode(spark: SparkSession, path: str, aggregates: bool = False) -> DataFrame:
    """Messages of databases (both tables) and files; the database goes first. A fork's copy of its parent's history is left out.

    Finished compactions count beside the messages. With aggregates, sessions
    without message usage give their running sums, which include compactions;
    sums can't be cut by time, so only a session report over all time takes them.
    Rows of session_message without a type are messages.
    """
    old = _open_database(spark, path, "message", "time_created")
    new = _open_database(spark, path, "session_message", "time_created", "type string, seq bigint, ").withColumn("place", F.coalesce("place", lit(2**63 - 1)))
    new = relate.copied_history(new, _fork_cutoffs(spark, path), ["src_file", "session_id"], "place")
    kind = F.coalesce("type", lit("assistant"))
    compacted = new.filter((kind == "compaction") & (c("j.status") == "completed"))
    files = parsed(documents(spark, path, "*.json"), _MESSAGE).filter("j.tokens is not null")
    when = F.coalesce(recorded_ms(c("j.time.created")), recorded_ms(c("time_created").cast("string")))
    parts = [_open_message(df, "opencode", c("session_id"), c("id"), when) for df in (old, new.filter(kind == "assistant"), compacted)]
    parts.append(_open_message(files, "opencode", c("j.sessionID"), F.coalesce("j.id", stem()), recorded_ms(c("j.time.created"))))
    parts = [dated(used(df, cost_only=True)).withColumn("_compaction", lit(i == 2)) for i, df in enumerate(parts)]
    rows = dedupe.with_priority(parts, [non_empty(c("message_id"))], "seq")
    if not aggregates:
        return rows.drop("_compaction")
    said = ~c("_compaction") & (total_tokens() > 0)
    whole = relate.not_counted(_open_sessions(spark, path), rows.filter(said), ["session_id"])
    rest = relate.not_counted(rows.filter(~said), whole, ["session_id"])
    return rows.filter(said).unionByName(rest).drop("_compaction").unionByName(whole)


@reader("kilo")
def kilo(spark: SparkSession, path: str) -> DataFrame:
    df = _open_database(spark, path, "message", "time_updated")
    out = _open_message(df, "kilo", c("session_id"), c("id"), F.coalesce(recorded_ms(c("j.time.created")), recorded_ms(c("time_updated").cast("string"))))
    return dated(used(dedupe.keep_first(out, [c("message_id")], "seq"), cost_only=True))


@reader("goose")
def goose(spark: SparkSession, path: str) -> DataFrame:
    k = [f"{a}{b}_tokens" for a in ("", "accumulated_") for b in ("total", "input", "output")]
    df = read_table(spark, path, "sessions", "id string, model_config_json string, provider_name string, created_at string, " + ", ".join(f"{x} bigint" for x in k) + ", src_file string")
    i, o = F.coalesce("accumulated_input_tokens", "input_tokens", lit(0)), F.coalesce("accumulated_output_tokens", "output_tokens", lit(0))
    out, extra = cost.fill_total(o, lit(0).cast("bigint"), i + o, F.coalesce("accumulated_total_tokens", "total_tokens", lit(0)))
    model = F.get_json_object("model_config_json", "$.model_name")
    rows = conform(df, "goose", session_id=c("id"), message_id=c("id"), ts_ms=recorded_ms(c("created_at")), model=model, provider=c("provider_name"), input_tokens=F.greatest(i, lit(0)), output_tokens=F.greatest(out, lit(0)), extra_total_tokens=extra, src_file=c("src_file"), seq=lit(0))
    return dated(used(dedupe.keep_best(rows, [c("session_id")], [total_tokens(), c("src_file")])))


@reader("hermes")
def hermes(spark: SparkSession, path: str) -> DataFrame:
    df = read_table(spark, path, "sessions", "id string, model string, billing_provider string, started_at string, message_count bigint, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint, reasoning_tokens bigint, estimated_cost_usd double, actual_cost_usd double, src_file string")
    z = lambda x: F.greatest(F.coalesce(c(x), lit(0)), lit(0))
    rows = conform(df, "hermes", session_id=c("id"), ts_ms=recorded_ms(c("started_at")), model=c("model"), provider=c("billing_provider"), input_tokens=z("input_tokens"), output_tokens=z("output_tokens"), extra_total_tokens=z("reasoning_tokens"), cache_read_tokens=z("cache_read_tokens"), cache_creation_tokens=z("cache_write_tokens"), cost_usd=F.coalesce("actual_cost_usd", "estimated_cost_usd"), message_count=c("message_count"), src_file=c("src_file"), seq=lit(0))
    return dated(used(rows, cost_only=True))


@reader("zcode")
def zcode(spark: SparkSession, path: str) -> DataFrame:
    df = read_table(spark, path, "model_usage", "id string, session_id string, started_at string, model_id string, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_creation_tokens bigint, computed_total_tokens bigint, provider_id string, status string, src_file string").filter("status = 'completed'")
    place = read_table(spark, path, "session", "id string, directory string, version string, src_file string").select(c("id").alias("session_id"), "directory", "version", "src_file")
    df = df.join(place, ["session_id", "src_file"], "left")
    i = F.greatest(F.coalesce("input_tokens", lit(0)), lit(0))
    cached, created = cost.clamped(i, F.coalesce("cache_read_tokens", lit(0)), F.coalesce("cache_creation_tokens", lit(0)))
    o, extra = cost.fill_total(F.coalesce("output_tokens", lit(0)), lit(0).cast("bigint"), i + F.coalesce("output_tokens", lit(0)), F.coalesce("computed_total_tokens", lit(0)))
    return dated(used(conform(df, "zcode", session_id=c("session_id"), project=c("directory"), message_id=c("id"), ts_ms=recorded_ms(c("started_at")), model=c("model_id"), provider=c("provider_id"), input_tokens=i - cached - created, output_tokens=o, extra_total_tokens=extra, cache_read_tokens=cached, cache_creation_tokens=created, version=c("version"), src_file=c("src_file"), seq=lit(0))))


_WIRE = "src_file string, idx bigint, rank int, key string, ids array<string>, id string, id_rank int, model string, ms bigint, input bigint, cache_creation bigint, cache_read bigint, output bigint, reasoning bigint, total bigint"
_ID_RANK = {"message": 1, "provider_message": 2, "response": 3}


def _decode(rank: int, one):  # noqa: ANN001, ANN202
    """A row for the usage of each blob and for that of each retry. A usage without ids goes by its steps, if any."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for src, idx, blob in zip(f["src_file"], f["idx"], f["data"]):
                whole = one(bytes(blob) if blob is not None else None)
                if not whole:
                    continue
                session = PurePosixPath(src).stem
                named = [f"step:{session}:{i}" for i in (whole.get("steps") or [] if rank else [idx])]
                for k, u in enumerate([whole, *whole["retries"]]):
                    if any(u.get(x) for x in wire.USAGE_FIELDS):
                        visible, reasoning = u.get("visible_output") or 0, u.get("reasoning") or 0
                        total = max(u.get("total_output") or 0, visible + reasoning)
                        output = max(visible, total - reasoning)
                        key = f"{src}:{rank}:{idx}" + (f":{k}" if k else "")
                        rows.append((src, idx, rank, key, u["ids"] or (named if k == 0 else []), u.get("id"), _ID_RANK.get(u.get("id_kind"), 0), whole["model"], whole["ms"], u.get("input") or 0, u.get("cache_creation") or 0, u.get("cache_read") or 0, output, max(reasoning, total - output), total))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in _WIRE.split(", ")])
            yield out.astype({"ms": "Int64"})

    return run


@reader("antigravity")
def antigravity(spark: SparkSession, path: str) -> DataFrame:
    """Generations, steps and their retries name the same call by any of several ids; each call counts once, each counter at its largest."""
    gen = read_table(spark, path, "gen_metadata", "idx bigint, data binary, src_file string").mapInPandas(_decode(1, wire.generation), _WIRE)
    step = read_table(spark, path, "steps", "idx bigint, metadata binary, src_file string").withColumnRenamed("metadata", "data").mapInPandas(_decode(0, wire.step), _WIRE)
    rows = cut(gen.unionByName(step), "calls")
    same = relate.shared_identities(rows.select("key", F.explode("ids").alias("ident")), "key", "ident")
    rows = ordered.carry_forward(rows, ["src_file", "rank"], ["idx"], "model", "carried").join(same, "key", "left")
    calls = rows.groupBy(F.coalesce("component", "key").alias("call")).agg(
        F.min("src_file").alias("src_file"), F.max_by("id", F.struct("id_rank", "rank", -c("idx"))).alias("id"), F.max_by("carried", F.struct(c("carried").isNotNull(), "rank")).alias("model"), F.max("ms").alias("ms"), F.min("idx").alias("seq"),
        *[F.max(k).alias(k) for k in ("input", "cache_creation", "cache_read", "output", "reasoning", "total")],
    )
    ident = F.coalesce(F.concat(lit("i:"), c("id")), F.concat(lit("r:"), c("call")))
    return dated(used(conform(calls, "antigravity", session_id=stem(), message_id=ident, ts_ms=c("ms"), model=c("model"), input_tokens=c("input"), output_tokens=F.greatest(c("total"), c("output") + c("reasoning")), cache_creation_tokens=c("cache_creation"), cache_read_tokens=c("cache_read"), src_file=c("src_file"), seq=c("seq"))))


def read_all(spark: SparkSession, paths: dict[str, str], aggregates: bool = False) -> DataFrame:
    """All named sources under one another; opencode rows of sessions and days that claude has counted are left out.

    aggregates also takes running sums of whole sessions, where there's nothing finer.
    """
    parts = {name: opencode(spark, path, aggregates) if name == "opencode" else READERS[name](spark, path) for name, path in paths.items()}
    if "claude" in parts and "opencode" in parts:
        mine = parts["opencode"]
        through = mine.filter("provider = 'claude-agent'")
        parts["opencode"] = mine.filter("provider is null or provider <> 'claude-agent'").unionByName(relate.not_counted(through, parts["claude"], ["session_id", "date"]).select(mine.columns))
    return relate.union_all(parts)
