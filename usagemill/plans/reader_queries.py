"""Each agent's reader on trial: its files are written from the usage table, read back and summed.

All rows of the table with a model and tokens go into the files; the SQL sums
the table itself. Sessions are numbered by record, so that a file tree has a
fixed number of folders.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagemill.plans.usage_queries import USAGE_SQL, query, usage
from usagemill.session import fresh_path
from usagemill.sources.agents import READERS

SESSIONS = 40
c, lit = F.col, F.lit


def base(s: SparkSession, d: str) -> DataFrame:
    """(seq, dir, ts_ms, at, model, i, o, c, r) of usable rows."""
    u = usage(s, d).filter(c("model").isNotNull())
    at = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    names = {"i": "input_tokens", "o": "output_tokens", "c": "cache_creation_tokens", "r": "cache_read_tokens"}
    return u.select("seq", F.concat(lit("s"), (c("seq") % SESSIONS).cast("string")).alias("dir"), "ts_ms", at.alias("at"), "model", *[c(v).alias(k) for k, v in names.items()])


def _rename(s: SparkSession, path: str, name: str) -> None:
    """Folders dir=x become x, and the one file in each gets its name; {} stands for x."""
    root = s._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(s._jsc.hadoopConfiguration())
    for folder in fs.listStatus(root):
        key = folder.getPath().getName().removeprefix("dir=")
        if folder.isDirectory():
            for f in fs.listStatus(folder.getPath()):
                new = s._jvm.org.apache.hadoop.fs.Path(folder.getPath(), name.replace("{}", key))
                fs.rename(f.getPath(), new)
            fs.rename(folder.getPath(), s._jvm.org.apache.hadoop.fs.Path(root, key))
        else:
            fs.delete(folder.getPath(), False)


def lines(df: DataFrame, raws: list[Column], name: str, under: str = "") -> str:
    """A folder for each dir with a file of JSON lines, in order of time; raws are a row's lines."""
    s = df.sparkSession
    top = fresh_path(s, "files")
    each = df.select("dir", "ts_ms", "seq", F.posexplode(F.array(*[F.to_json(x) for x in raws])).alias("_k", "value"))
    each.repartition("dir").sortWithinPartitions("dir", "ts_ms", "seq", "_k").select("dir", "value").write.partitionBy("dir").option("maxRecordsPerFile", 0).text(f"{top}{under}")
    _rename(s, f"{top}{under}", name)
    return top


def documents(df: DataFrame, document: Column, name: str, under: str = "") -> str:
    """A folder for each dir with one JSON document."""
    s = df.sparkSession
    top = fresh_path(s, "files")
    df.groupBy("dir").agg(F.to_json(document).alias("value")).repartition("dir").write.partitionBy("dir").text(f"{top}{under}")
    _rename(s, f"{top}{under}", name)
    return top


def databases(df: DataFrame, table: str, columns: dict[str, Column]) -> str:
    """A SQLite file for each partition. The shared folder must be mounted, as SQLite needs a file system."""
    top = fresh_path(df.sparkSession, "files")
    local, names = top.removeprefix("file://"), list(columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        os.makedirs(local, exist_ok=True)
        con = sqlite3.connect(f"{local}/{TaskContext.get().partitionId()}.db")
        con.execute(f"CREATE TABLE IF NOT EXISTS {table} ({', '.join(names)})")
        con.execute(f"DELETE FROM {table}")
        for f in frames:
            con.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(names))})", f.astype(object).where(f.notna(), None).values.tolist())
        con.commit()
        con.close()
        yield pd.DataFrame({"done": [1]})

    df.select(*[x.alias(n) for n, x in columns.items()]).repartition(4).mapInPandas(run, "done int").count()
    return top


def obj(**fields: Column | str | int) -> Column:
    return F.struct(*[(x if isinstance(x, Column) else lit(x)).alias(k) for k, x in fields.items()])


def listed(x: Column, *order: str) -> Column:
    """The group's rows as an array in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, x.alias("x")))), lambda e: e["x"])


def _sql(created: bool = True, cached: bool = True, by_session: bool = True, once: str = "", prefix: str = "s") -> str:
    session = f"'{prefix}' || (seq % {SESSIONS})" if by_session else "'all'"
    some = "i + o" + (" + c" if created else "") + (" + r" if cached else "")
    kept = f"QUALIFY row_number() OVER (PARTITION BY {session}, {once} ORDER BY seq) = 1" if once else ""
    return f"""WITH {USAGE_SQL}, rows AS (SELECT * FROM usage WHERE model IS NOT NULL AND {some} > 0 {kept})
SELECT {session} AS session_id, model, count(*) AS entries, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, {"sum(c)::BIGINT" if created else "0::BIGINT"} AS cache_creation_tokens,
{"sum(r)::BIGINT" if cached else "0::BIGINT"} AS cache_read_tokens, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM rows GROUP BY 1, 2"""


def trial(name: str, sql: str | None = None, by_session: bool = True, **options: bool | str):  # noqa: ANN201
    """Registers read_<name>: the function writes the agent's files and gives their place."""

    def add(write: Callable[[DataFrame], str]) -> Callable[[DataFrame], str]:
        def run(s: SparkSession, d: str) -> DataFrame:
            rows = READERS[name](s, write(base(s, d)))
            keys = [c("session_id") if by_session else lit("all").alias("session_id"), c("model")]
            sums = [F.sum(x).alias(x) for x in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")]
            return rows.groupBy(*keys).agg(F.count(lit(1)).alias("entries"), *sums, F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))

        run.__name__ = f"read_{name}"
        query(sql or _sql(by_session=by_session, **options))(run)
        return write

    return add


def ident(prefix: str) -> Column:
    return F.concat(lit(prefix), c("seq").cast("string"))


_EQUAL = "ts_ms, model, i, o, r"


@trial("claude")
def _claude(df):
    message = obj(id=ident("msg_"), model=c("model"), usage=obj(input_tokens=c("i"), output_tokens=c("o"), cache_creation_input_tokens=c("c"), cache_read_input_tokens=c("r")))
    return lines(df, [obj(timestamp=c("at"), sessionId=c("dir"), version="1.0.0", requestId=ident("req-"), message=message)], "log.jsonl", "/projects")


_USES = "input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "total_tokens"


@trial("codex", f"""WITH {USAGE_SQL}, per AS (SELECT ts_ms, model, i, o, c, r, seq % {SESSIONS} AS f, count(*) AS n FROM usage WHERE model IS NOT NULL AND i + o + c + r > 0 GROUP BY ALL),
kept AS (SELECT ts_ms, model, i, o, c, r, max(n) AS n FROM per GROUP BY ALL)
SELECT 'all' AS session_id, model, sum(n)::BIGINT AS entries, sum(i * n)::BIGINT AS input_tokens, sum(o * n)::BIGINT AS output_tokens, sum(c * n)::BIGINT AS cache_creation_tokens, sum(r * n)::BIGINT AS cache_read_tokens, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM kept GROUP BY 2""", by_session=False)  # fmt: skip
def _codex(df):
    """Running totals beside the last request's use; copies of an event in other files count once."""
    upto = Window.partitionBy("dir").orderBy("ts_ms", "seq").rowsBetween(Window.unboundedPreceding, 0)
    each = {"input_tokens": c("i") + c("c") + c("r"), "cached_input_tokens": c("r"), "cache_write_input_tokens": c("c"), "output_tokens": c("o"), "total_tokens": c("i") + c("c") + c("r") + c("o")}
    df = df.filter(each["total_tokens"] > 0).withColumns({k: v for k, v in each.items()}).withColumns({f"all_{k}": F.sum(v).over(upto) for k, v in each.items()})
    info = obj(model=c("model"), last_token_usage=obj(**{k: c(k) for k in _USES}), total_token_usage=obj(**{k: c(f"all_{k}") for k in _USES}))
    return lines(df, [obj(timestamp=c("at"), type="event_msg", payload=obj(type="token_count", info=info))], "rollout-{}.jsonl", "/sessions")


@trial("copilot")
def _copilot(df):
    """Snapshots of a session's running sums."""
    upto = Window.partitionBy("dir", "model").orderBy("ts_ms", "seq").rowsBetween(Window.unboundedPreceding, 0)
    run = lambda x: F.sum(x).over(upto)
    df = df.withColumns({"si": run(c("i") + c("r")), "so": run(c("o")), "sr": run(c("r")), "sc": run(c("c")), "n": run(lit(1))})
    metrics = F.create_map(c("model"), obj(usage=obj(inputTokens=c("si"), outputTokens=c("so"), cacheReadTokens=c("sr"), cacheWriteTokens=c("sc")), requests=obj(count=c("n"))))
    return lines(df, [obj(type="session.shutdown", id=ident("e"), timestamp=c("at"), data=obj(modelMetrics=metrics))], "events.jsonl")


@trial("gemini", created=False)
def _gemini(df):
    tokens = obj(input=c("i") + c("r"), output=c("o"), cached=c("r"), thoughts=0, tool=0, total=c("i") + c("r") + c("o"))
    return lines(df, [obj(sessionId=c("dir"), id=ident("g"), timestamp=c("at"), type="gemini", model=c("model"), tokens=tokens)], "chat.jsonl")


@trial("qwen", created=False)
def _qwen(df):
    use = obj(promptTokenCount=c("i") + c("r"), candidatesTokenCount=c("o"), thoughtsTokenCount=0, cachedContentTokenCount=c("r"), totalTokenCount=c("i") + c("r") + c("o"))
    return lines(df, [obj(type="assistant", id=ident("q"), timestamp=c("at"), sessionId=c("dir"), model=c("model"), usageMetadata=use)], "chat.jsonl")


@trial("kimi", once=_EQUAL)
def _kimi(df):
    use = obj(inputOther=c("i"), output=c("o"), inputCacheRead=c("r"), inputCacheCreation=c("c"))
    record = lambda scope: obj(type="usage.record", usageScope=scope, time=c("ts_ms"), model=c("model"), usage=use)
    return lines(df, [record("turn"), record("session")], "wire.jsonl")


@trial("grok")
def _grok(df):
    use = obj(inputTokens=c("i") + c("c") + c("r"), outputTokens=c("o"), cachedReadTokens=c("r"), cacheCreationTokens=c("c"), totalTokens=c("i") + c("c") + c("r") + c("o"))
    update = obj(sessionUpdate="turn_completed", usage=obj(modelUsage=F.create_map(c("model"), use)))
    return lines(df, [obj(params=obj(sessionId=c("dir"), _meta=obj(eventId=ident("e"), timestamp=c("at")), update=update))], "updates.jsonl")


@trial("pi")
def _pi(df):
    use = obj(input=c("i"), output=c("o"), cacheRead=c("r"), cacheWrite=c("c"), totalTokens=c("i") + c("o") + c("r") + c("c"))
    said = obj(type="message", id=ident("m"), timestamp=c("at"), message=obj(role="assistant", model=c("model"), usage=use))
    return lines(df, [obj(type="session", id=c("dir"), timestamp=c("at"), cwd="/w"), said], "{}.jsonl")


@trial("openclaw")
def _openclaw(df):
    """The model comes from the change before the message."""
    use = obj(input=c("i"), output=c("o"), cacheRead=c("r"), cacheWrite=c("c"))
    said = obj(type="message", id=ident("m"), message=obj(role="assistant", timestamp=c("ts_ms"), usage=use))
    return lines(df, [obj(type="model_change", provider="x", modelId=c("model")), said], "{}.jsonl")


@trial("amp")
def _amp(df):
    """Counts of the ledger, cache counts of the messages it leads to."""
    message = obj(role="assistant", messageId=ident("m"), usage=obj(cacheReadInputTokens=c("r"), cacheCreationInputTokens=c("c")))
    event = obj(id=ident("e"), timestamp=c("at"), model=c("model"), tokens=obj(input=c("i"), output=c("o"), total=c("i") + c("o")), toMessageId=ident("m"))
    return documents(df, F.struct(F.first("dir").alias("id"), listed(message, "seq").alias("messages"), F.struct(listed(event, "seq").alias("events")).alias("usageLedger")), "{}.json")


@trial("cline")
def _cline(df):
    message = obj(id=ident("m"), role="assistant", ts=c("ts_ms"), modelInfo=obj(id=c("model"), provider="x"), metrics=obj(inputTokens=c("i"), outputTokens=c("o"), cacheReadTokens=c("r"), cacheWriteTokens=c("c")))
    return documents(df, F.struct(F.first("dir").alias("sessionId"), listed(message, "seq").alias("messages")), "{}.messages.json")


@trial("codebuff", prefix="a/b/s")
def _codebuff(df):
    use = obj(inputTokens=c("i"), outputTokens=c("o"), cacheReadTokens=c("r"), cacheCreationTokens=c("c"))
    return documents(df, listed(obj(id=ident("m"), variant="ai", timestamp=c("at"), metadata=obj(model=c("model"), usage=use)), "seq"), "chat-messages.json", "/a/b")


def _stored() -> Column:
    tokens = obj(input=c("i"), output=c("o"), reasoning=0, cache=obj(read=c("r"), write=c("c")))
    return F.to_json(obj(id=ident("m"), role="assistant", providerID="x", modelID=c("model"), time=obj(created=c("ts_ms")), tokens=tokens))


@trial("opencode")
def _opencode(df):
    return databases(df, "message", {"id": ident("m"), "session_id": c("dir"), "data": _stored(), "time_created": c("ts_ms")})


@trial("kilo")
def _kilo(df):
    return databases(df, "message", {"id": ident("m"), "session_id": c("dir"), "data": _stored(), "time_updated": c("ts_ms")})


@trial("goose", by_session=False, created=False, cached=False)
def _goose(df):
    model = F.to_json(obj(model_name=c("model")))
    return databases(df, "sessions", {"id": ident("g"), "model_config_json": model, "provider_name": lit("x"), "created_at": c("at"), "accumulated_total_tokens": c("i") + c("o"), "accumulated_input_tokens": c("i"), "accumulated_output_tokens": c("o")})


@trial("hermes", by_session=False)
def _hermes(df):
    return databases(df, "sessions", {"id": ident("h"), "model": c("model"), "started_at": c("at"), "message_count": lit(1), "input_tokens": c("i"), "output_tokens": c("o"), "cache_read_tokens": c("r"), "cache_write_tokens": c("c"), "reasoning_tokens": lit(0)})


@trial("zcode")
def _zcode(df):
    return databases(df, "model_usage", {"id": ident("z"), "session_id": c("dir"), "started_at": c("at"), "model_id": c("model"), "input_tokens": c("i") + c("c") + c("r"), "output_tokens": c("o"), "cache_read_tokens": c("r"), "cache_creation_tokens": c("c"), "computed_total_tokens": c("i") + c("c") + c("r") + c("o"), "status": lit("completed")})


@trial("droid", f"""WITH {USAGE_SQL}, rows AS (SELECT *, seq % {SESSIONS} AS f FROM usage WHERE model IS NOT NULL)
SELECT 's' || f AS session_id, arg_min(model, seq) AS model, 1::BIGINT AS entries, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, sum(c)::BIGINT AS cache_creation_tokens, sum(r)::BIGINT AS cache_read_tokens, min(ts_ms) AS first_ms, min(ts_ms) AS last_ms FROM rows GROUP BY f HAVING sum(total) > 0""")  # fmt: skip
def _droid(df):
    """A session's sums, dated by its first message."""
    use = F.struct(F.sum("i").alias("inputTokens"), F.sum("o").alias("outputTokens"), F.sum("c").alias("cacheCreationTokens"), F.sum("r").alias("cacheReadTokens"))
    return documents(df, F.struct(F.min_by("model", "seq").alias("model"), F.min("at").alias("providerLockTimestamp"), use.alias("tokenUsage")), "{}.settings.json")
