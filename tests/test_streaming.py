from pyspark.sql import functions as F

from usagemill.operators.delivery import SeenMessages, response_identity
from usagemill.operators.sessions import SessionTable
from usagemill.streaming.ingest import accept_once, batch_sink, ingest, keep_sessions, once, tumbling

EVENTS = "user string, n bigint, ts timestamp"


def feed(spark, rows, path):
    spark.createDataFrame(rows, "user string, n bigint, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)


def test_ingest_takes_each_file_once_and_can_be_restarted(spark, tmp_path):
    src, to, cp = (f"file://{tmp_path}/{x}" for x in ("src", "to", "cp"))
    feed(spark, [("a", 1, "2025-01-01 00:00:00")], src)
    ingest(spark, src, EVENTS, to, cp).awaitTermination(120)
    feed(spark, [("b", 2, "2025-01-01 00:00:00")], src)
    for _ in range(2):
        ingest(spark, src, EVENTS, to, cp).awaitTermination(120)
    assert sorted(r.user for r in spark.read.parquet(to).collect()) == ["a", "b"]
    batch_sink(to)(spark.createDataFrame([("c", 3)], "user string, n bigint"), 0)
    assert sorted(r.user for r in spark.read.parquet(to).collect()) == ["b", "c"]


def test_once_and_windows(spark, tmp_path):
    src, cp = f"file://{tmp_path}/src", f"file://{tmp_path}/cp"
    feed(spark, [("a", 1, "2025-01-01 00:00:00"), ("a", 1, "2025-01-01 00:00:30"), ("b", 5, "2025-01-01 00:01:00")], src)
    stream = spark.readStream.schema(EVENTS).parquet(src)
    q = once(stream, ["user", "n"], "ts", "10 minutes").writeStream.format("memory").queryName("kept").option("checkpointLocation", cp).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("kept").count() == 2
    w = tumbling(stream, "ts", "1 minute", "0 seconds", ["user"], "n").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert sorted((r.user, r.n, r.value) for r in spark.table("windows").collect()) == [("a", 2, 2), ("b", 1, 5)]


def test_sessions_and_messages_of_batches_run_twice(spark, tmp_path):
    table = SessionTable(spark, ["session_id"], f"file://{tmp_path}/s", 4)
    merge = keep_sessions(table)
    rows = lambda *ts: spark.createDataFrame([("a", t, 10) for t in ts], "session_id string, time_ms bigint, gap_ms bigint")
    merge(rows(0, 5), 0)
    merge(rows(), 1)
    merge(rows(14), 2)
    again = SessionTable(spark, ["session_id"], f"file://{tmp_path}/s", 4)
    keep_sessions(again)(rows(14), 2)
    assert [(r.start_ms, r.end_ms, r.event_count) for r in again.read().collect()] == [(0, 14, 3)]
    seen = SeenMessages(spark, f"file://{tmp_path}/seen")
    write = accept_once(seen, f"file://{tmp_path}/out", response_identity)
    batch = lambda *r: spark.createDataFrame([(i, (x,)) for i, x in r], "record_id bigint, payload struct<response_id string>")
    write(batch((1, "r-1"), (2, "r-1"), (3, "odd")), 0)
    write(batch((4, "r-2"), (5, "odd"), (6, "r-1")), 1)
    write(batch((4, "r-2"), (5, "odd"), (6, "r-1")), 1)
    assert sorted(r.record_id for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [1, 3, 4]
