"""Queries of the general data problems, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagemill.operators import clocks, delivery, drift, hierarchy, quarantine, sessions

TRACKED = ["payload.model", "payload.model_name", "payload.info.model", "message.usage.speed"]
#: Paths that name the columns of the unified table; renames lead to the others of PATHS.
SEEDS = {"model": ["payload.model", "message.model"], "speed": ["message.usage.speed"]}
PATHS = ["payload.model", "message.model", *TRACKED[1:]]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _forest(spark: SparkSession, folder: str) -> DataFrame:
    meta = table(spark, folder, "codex_meta")
    return hierarchy.hierarchy(meta, F.col("payload.id"), F.col("payload.forked_from_id"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _forest(spark, folder).select("node_id", "kind", "root_id", "depth", "node_path", "descendants")


def p1_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """The back edge of each loop."""
    return _forest(spark, folder).filter("closes_cycle").select("node_id", "parent_id")


def p1_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Size, depth and leaves of each tree."""
    trees = _forest(spark, folder).filter(F.col("kind") == "tree").groupBy("root_id")
    return trees.agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("max_depth"), F.count_if(F.col("descendants") == 0).alias("leaves"))


def _raw(spark: SparkSession, folder: str) -> tuple:
    return table(spark, folder, "raw_records"), F.col("record_id"), F.col("layout"), F.col("raw")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return quarantine.quarantine(*_raw(spark, folder))


def p2_loaded(spark: SparkSession, folder: str) -> DataFrame:
    return quarantine.load_valid(*_raw(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    usage = delivery.superfluous_seen(delivery.usage_identity(table(spark, folder, "claude_usage"))).withColumn("table_name", F.lit("claude_usage"))
    codex = delivery.superfluous_seen(delivery.response_identity(table(spark, folder, "codex_records"))).withColumn("table_name", F.lit("codex_records"))
    return usage.unionByName(codex).select("table_name", "keep_id", "drop_id")


def p5_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Lines seen per file: the file is the producer, its line numbers the sequence."""
    seen = []
    for name in ("claude_usage", "codex_records"):
        rows = table(spark, folder, name).select(F.lit(name).alias("table_name"), "src_file", F.col("line_no").cast("bigint").alias("line_no"))
        seen.append(rows)
    found = delivery.number_ranges(seen[0].unionByName(seen[1]), ["table_name", "src_file"], "line_no")
    return found.select("table_name", "src_file", F.col("lo").alias("first_line"), F.col("hi").alias("last_line"))


def p5_by_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Both tables through seen ranges in three deliveries by batch: copies accepted of each. Rows without a batch come first."""
    out = None
    for name, identity in (("claude_usage", delivery.usage_identity), ("codex_records", delivery.response_identity)):
        records, seen = table(spark, folder, name), delivery.SeenMessages(spark)
        lo, hi = records.agg(F.min("batch_id"), F.max("batch_id")).first()
        lo, hi = (lo, hi) if lo is not None else (0, 0)
        width = (hi - lo) // 3 + 1
        step = F.coalesce(F.expr(f"(batch_id - {lo}) div {width}"), F.lit(0))
        for i in range(3):
            accepted = seen.accept(identity(records.filter(step == i))).agg(F.lit(name).alias("table_name"), F.lit(i).cast("bigint").alias("delivery"), F.count(F.lit(1)).alias("accepted"))
            out = accepted if out is None else out.unionByName(accepted)
    return out


def _usage_events(spark: SparkSession, folder: str) -> DataFrame:
    usage = table(spark, folder, "claude_usage")
    usage = usage.select("record_id", "batch_id", "sessionId", "project", "timestamp", F.col("message.id").alias("ident"), delivery.usage_scope().alias("scope"))
    kept = delivery.first_copies(usage.select("record_id", "batch_id", "sessionId", "project", sessions.instant_ms(F.col("timestamp")).alias("time_ms"), "ident", "scope"), F.col("ident"), F.col("scope"), "record_id")
    named = kept.drop("ident", "scope").filter(F.col("time_ms").isNotNull() & delivery.filled(F.col("sessionId")).isNotNull())
    config = table(spark, folder, "report_config").select("project", F.col("commands.blocks.sessionLength").alias("hours"))
    return sessions.with_gap(named, config, "project")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    events = _usage_events(spark, folder).select("batch_id", F.col("sessionId").alias("session_id"), "project", "time_ms", "gap_ms")
    batches = table(spark, folder, "claude_usage").agg(F.min("batch_id"), F.max("batch_id")).first()
    found = sessions.sessionise(events, ["session_id", "project"], "batch_id", bounds=tuple(batches)).read()
    return found.select("session_id", "project", "start_ms", "end_ms", "event_count")


def _clock(spark: SparkSession, folder: str) -> tuple:
    text = F.coalesce("timestamp", "session.ts", "trace.endTime", "loader.started_at")
    return table(spark, folder, "agent_clock"), F.col("record_id"), F.col("agent"), text, F.col("host_zone")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return clocks.normalise(*_clock(spark, folder)).select("record_id", "status", "utc_us")


def p4_formats(spark: SparkSession, folder: str) -> DataFrame:
    """Readings per agent, format chosen and status."""
    df, record_id, agent, text, zone = _clock(spark, folder)
    out = clocks.normalise(df, record_id, agent, text, zone)
    return out.groupBy(F.coalesce("format", F.lit("")).alias("format"), "status").agg(F.count(F.lit(1)).alias("readings"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The changes of the tracked paths, from the report of all columns."""
    return drift.narrowed(p6_changes(spark, folder), TRACKED)


def p6_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The changes of every column, renames by the matching of all that went with all that came."""
    return drift.changes(table(spark, folder, "log_lines"), "stream", "file_seq", "src_file", "raw", None, drift.MIN_SCORE, sole=False)


def p6_renames(spark: SparkSession, folder: str) -> DataFrame:
    """Renames by the matching alone, also where several paths went or came at once."""
    lines = table(spark, folder, "log_lines")
    found = drift.renames(drift.versions(drift.profiles(lines, "stream", "file_seq", "src_file", "raw", TRACKED)))
    return found.withColumn("score", F.round("score", 6))


def p6_unified(spark: SparkSession, folder: str) -> DataFrame:
    return drift.unified_by_matches(table(spark, folder, "log_lines"), "stream", "file_seq", "src_file", "raw", SEEDS, PATHS, ["line_id", "stream", "src_file", "line_no"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_cycles, p1_trees, p2_found, p2_loaded, p3_found, p4_found, p4_formats, p5_found, p5_ranges, p5_by_batch, p6_found, p6_changes, p6_renames, p6_unified)
}
