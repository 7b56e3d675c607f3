"""Grouping activity into sessions separated by inactivity gaps.

Sessions are kept in a table that grows by batches. Each batch's events are
first reduced to local sessions; those are compared with the stored sessions
within the gap, sessions bridged by new events are merged, and the rows
affected are replaced at once by publishing a new version of the table.

Local sessions need no sort of the events: all events of a key that fall into
one slot no wider than the gap belong to one session, so an aggregation per
slot (combined on the map side, and spread over the slots of a hot key) comes
first. Only slots are put in order, and a key has at most time span / gap of
those, however many events it has.

Defined results
    gap                       a new session begins where the time since the
                              previous event is greater than the gap
    events at one instant     one session; a gap of zero or below splits
                              different instants only
    null time or null key     the event is not counted
    null gap                  the default gap
    null batch                the event comes with the first batches
    late events               may start, extend or bridge stored sessions
    a table opened again      keeps the keys and buckets it was made with; other
                              keys are refused
    empty batch               leaves the table as it is
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagemill.operators.delivery import filled
from usagemill.session import Manifest, cut_counted, delete_path, fresh_path

DEFAULT_GAP_MS = 5 * 3_600_000
BUCKETS = 64
ROWS_PER_BUCKET = 500_000
SPAN_MS = 91 * 86_400_000
KEEP_MS = 6 * 3_600_000
MAX_WRITERS = 4_096
MAX_BOUNDS = 5_000
#: An ISO 8601 instant: date, T, time, any fraction, Z or an offset.
INSTANT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?(?:[Zz]|[+-][0-9]{2}(?::?[0-5][0-9])?)\z"


def instant_ms(text: Column) -> Column:
    """Epoch milliseconds of an ISO 8601 instant, null for anything else. Finer digits are cut off.

    One pattern holds the form; the built-in cast, which is far cheaper than
    picking out groups, does the rest.
    """
    t = F.upper(F.translate(F.trim(text), ",", "."))
    full = F.when(F.substring(t, 17, 1) == ":", t).otherwise(F.concat(F.substring(t, 1, 16), F.lit(":00"), F.substring(t, 17, 6)))
    return F.when(t.rlike(INSTANT), F.unix_millis(full.try_cast("timestamp")))


def local_sessions(events: DataFrame, keys: list[str], time: str, gap: str, by: list[str] | None = None) -> DataFrame:
    """Sessions of (keys, time, gap) rows: (by, keys, gap, start_ms, end_ms, event_count).

    by names columns that keep batches apart: events of different batches are
    not merged here.
    """
    group = [*(by or []), *keys, gap]
    width = F.greatest(F.col(gap), F.lit(1))
    slots = events.groupBy(*group, F.floor(F.col(time) / width).alias("_slot")).agg(
        F.min(time).alias("start_ms"), F.max(time).alias("end_ms"), F.count(F.lit(1)).alias("event_count")
    )
    return merge_sessions(slots.drop("_slot"), [*(by or []), *keys], gap)


def merge_sessions(parts: DataFrame, keys: list[str], gap: str) -> DataFrame:
    """Joins (keys, gap, start_ms, end_ms, event_count) rows that lie within the gap of each other."""
    w = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start_ms") - reach > F.greatest(F.col(gap), F.lit(0))), 1).otherwise(0)
    rows = parts.withColumn("_new", fresh)
    rows = rows.withColumn("_part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy(*keys, "_part").agg(F.max(gap).alias(gap), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("event_count").alias("event_count"))
    return merged.drop("_part")


class SessionTable:
    """A stored table of sessions, in buckets by key hash and spans of end time, and in versions.

    A version is a manifest that says which folder holds each bucket and span.
    A batch reads those it can reach only: of each bucket its keys fall into,
    the spans from its earliest session, less the gap, on. Of the rows read,
    those within the gap of a session of the batch are merged with it; the
    others are written as they are. New folders are written beside the old ones
    and put in force by the next manifest: readers of former versions are not
    disturbed until vacuum removes what is older than they may be, and a job
    that dies before leaves no trace in the table.
    """

    def __init__(self, spark: SparkSession, keys: list[str], path: str | None = None, buckets: int = BUCKETS, span_ms: int = SPAN_MS) -> None:
        self.spark, self.keys, self.buckets, self.span_ms = spark, keys, buckets, span_ms
        self.path = path or fresh_path(spark, "sessions")
        self.where, self.batch = {}, -1
        self.manifest = Manifest(spark, self.path)
        stored = self.manifest.newest()
        if stored:
            if stored["keys"] != keys:
                raise ValueError(f"{self.path} holds sessions by {stored['keys']}, not by {keys}")
            self.buckets, self.span_ms, self.batch = stored["buckets"], stored["span_ms"], stored["batch"]
            self.where = {tuple(map(int, k.split("/"))): v for k, v in stored["where"].items()}

    @property
    def version(self) -> int:
        return self.manifest.version

    def schema(self) -> str:
        return ", ".join([*(f"{k} string" for k in self.keys), "gap_ms bigint", "start_ms bigint", "end_ms bigint", "event_count bigint"])

    def read(self, parts: list[tuple[int, int]] | None = None) -> DataFrame:
        """The current version, or some of its buckets and spans."""
        paths = sorted(f"{self.path}/{v}/_bucket={b}/_span={s}" for (b, s), v in self.where.items() if parts is None or (b, s) in parts)
        return self.spark.read.schema(self.schema()).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def span(self, ms: str | Column) -> Column:
        return F.floor((F.col(ms) if isinstance(ms, str) else ms) / self.span_ms).cast("bigint")

    def apply(self, local: DataFrame, batch: int | None = None) -> None:
        """Merge a batch's local sessions (keys, gap_ms, start_ms, end_ms, event_count) into the table.

        Numbered batches are taken once: the manifest holds the last number, so
        a batch that is run again after its commit changes nothing.
        """
        if batch is not None and batch <= self.batch:
            return
        local = local.select(*self.keys, "gap_ms", "start_ms", "end_ms", "event_count")
        reach = self.span(F.min(F.col("start_ms") - F.greatest(F.col("gap_ms"), F.lit(0))))
        hit = {r[0]: r[1] for r in local.groupBy(self.bucket().alias("b")).agg(reach.alias("s")).collect()}
        if not hit:
            return
        old = {(b, s) for b, s in self.where if b in hit and s >= hit[b]}
        merged = self._merged(self.read(list(old)), local) if old else merge_sessions(local, self.keys, "gap_ms")
        folder = f"v{self.version + 1}-{uuid.uuid4().hex[:8]}"
        placed = merged.withColumns({"_bucket": self.bucket(), "_span": self.span("end_ms")})
        # One file a bucket: rows of a bucket meet in one task, which is how the number of buckets bounds a task.
        placed.repartition(min(len(hit), MAX_WRITERS), "_bucket").write.partitionBy("_bucket", "_span").option("compression", "zstd").parquet(f"{self.path}/{folder}")
        where = {k: v for k, v in self.where.items() if k not in old} | dict.fromkeys(self._parts(folder), folder)
        self.batch = self.batch if batch is None else batch
        self.manifest.publish({"keys": self.keys, "buckets": self.buckets, "span_ms": self.span_ms, "batch": self.batch, "where": {f"{b}/{s}": v for (b, s), v in where.items()}})
        self.where = where

    def _merged(self, stored: DataFrame, local: DataFrame) -> DataFrame:
        """stored and local in one, where only stored sessions that the batch reaches are put in order again.

        Stored sessions of a key are further apart than the gap, so one that no
        session of the batch comes near stays as it is, whatever is merged.
        """
        keys, gap = self.keys, F.greatest(F.col("gap_ms"), F.lit(0))
        bounds = local.groupBy(*keys).agg(F.min(F.col("start_ms") - gap).alias("_lo"), F.max(F.col("end_ms") + gap).alias("_hi"))
        small = bounds.limit(MAX_BOUNDS + 1).count() <= MAX_BOUNDS
        marked = stored.join(F.broadcast(bounds) if small else bounds, keys, "left")
        near = F.coalesce((F.col("end_ms") >= F.col("_lo")) & (F.col("start_ms") <= F.col("_hi")), F.lit(False))
        columns = stored.columns
        return merge_sessions(marked.filter(near).select(*columns).unionByName(local), keys, "gap_ms").unionByName(marked.filter(~near).select(*columns))

    def _parts(self, folder: str) -> list[tuple[int, int]]:
        """The buckets and spans that a written folder has."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs, found = root.getFileSystem(self.spark._jsc.hadoopConfiguration()), []
        for b in fs.listStatus(root):
            if b.isDirectory():
                found += [(int(b.getPath().getName().split("=")[1]), int(s.getPath().getName().split("=")[1])) for s in fs.listStatus(b.getPath())]
        return found

    def rebucket(self, buckets: int) -> None:
        """Write the whole table again in another number of buckets; former versions stay readable."""
        rows = self.read()
        self.buckets = buckets
        folder = f"v{self.version + 1}-{uuid.uuid4().hex[:8]}"
        rows.withColumns({"_bucket": self.bucket(), "_span": self.span("end_ms")}).repartition(min(buckets, MAX_WRITERS), "_bucket").write.partitionBy("_bucket", "_span").option("compression", "zstd").parquet(f"{self.path}/{folder}")
        self.where = dict.fromkeys(self._parts(folder), folder)
        self.manifest.publish({"keys": self.keys, "buckets": buckets, "span_ms": self.span_ms, "batch": self.batch, "where": {f"{b}/{s}": v for (b, s), v in self.where.items()}})

    def vacuum(self, older_than_ms: int = KEEP_MS) -> None:
        """Remove folders that the current version doesn't name and that were written longer ago than a reader may take."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        now, used = self.spark._jvm.java.lang.System.currentTimeMillis(), set(self.where.values())
        for s in fs.listStatus(root) if self.where else ():
            name = s.getPath().getName()
            if name.startswith("v") and name not in used and now - s.getModificationTime() >= older_than_ms:
                delete_path(self.spark, s.getPath().toString())


def with_gap(events: DataFrame, config: DataFrame, project: str, default_ms: int = DEFAULT_GAP_MS, max_config: int = 100_000) -> DataFrame:
    """events with gap_ms: the project's limit, else that of `*`, else default_ms.

    config has (project, hours). Its size doesn't grow with the events; it is
    broadcast up to max_config rows, and joined by shuffle beyond.
    """
    limits = config.filter(F.col("hours").isNotNull()).groupBy("project").agg(F.max(F.floor(F.col("hours") * 3_600_000)).alias("gap_ms"))
    star = limits.filter(F.col("project") == "*").select("gap_ms").first()
    named = limits.filter(F.col("project") != "*").withColumnRenamed("project", project)
    joined = events.join(F.broadcast(named) if limits.count() <= max_config else named, project, "left")
    return joined.withColumn("gap_ms", F.coalesce(F.col("gap_ms"), F.lit(star[0] if star else default_ms)).cast("bigint"))


def sessionise(events: DataFrame, keys: list[str], batch: str, increments: int = 3, bounds: tuple | None = None, buckets: int | None = None) -> SessionTable:
    """Feeds (batch, keys, time_ms, gap_ms) rows, in increments of whole batches, into a new table.

    bounds are the least and greatest batch, if they can be had more cheaply
    than from the events. The batches are all there already, so their local
    sessions are made in one pass, each batch's apart; buckets follow their
    number unless given.
    """
    spark = events.sparkSession
    bounds = bounds or events.agg(F.min(batch), F.max(batch)).first()
    least, most = bounds if bounds[0] is not None else (0, 0)
    span = max(1, -(-(most - least + 1) // increments))
    step = F.coalesce(F.floor((F.col(batch) - least) / span).cast("int"), F.lit(0))
    local, n = cut_counted(local_sessions(events.withColumn("_step", step), keys, "time_ms", "gap_ms", ["_step"]), "local", n=F.count(F.lit(1)))
    table = SessionTable(spark, keys, buckets=max(1, -(-n["n"] // ROWS_PER_BUCKET)) if buckets is None else buckets)
    for i in range(increments):
        table.apply(local.filter(F.col("_step") == i))
    return table


__all__ = ["SessionTable", "filled", "instant_ms", "local_sessions", "merge_sessions", "sessionise", "with_gap"]
