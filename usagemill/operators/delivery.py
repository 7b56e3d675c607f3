"""Messages delivered more than once: keep exactly one copy of each.

An identifier that ends in a number of its producer (decimal, or 16 hexadecimal
digits) is read as (producer, number). Numbers are accepted once: those inside
a range already seen are superfluous, the others are accepted and merged into
the producer's disjoint ranges. Identifiers of any other form are resolved by
exact keyed lookup. Which copy is kept is the least order value of the message.

The remaining identity columns (request, session) are part of the producer: two
messages with one number but different requests are different.

Seen ranges are kept in pieces that never leave a block of 2^BITS numbers. A
block that is full becomes one number of the level above, where it is merged
the same way, so a run of any length takes at most two pieces a level. A number
is looked up by its block at each level there is: an equality join that meets
at most half a block of pieces, whatever the ranges' lengths are.

Defined results
    ids are compared trimmed of spaces, case counts
    a null or blank id     no identity; the row is never superfluous
    equal order values     equal rows of one message: one is kept, none is listed
    empty input            empty result
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagemill.operators.skew import lookup_join
from usagemill.session import Manifest, cut, cut_counted, fresh_path

HEX = r"^(.*[^0-9a-f])([0-9a-f]{16})\z"
DECIMAL = r"^(.*[^0-9])([1-9][0-9]{0,17}|0)\z"
BLOCK = 65_536
BITS = 8
MAX_DELTAS = 16


def filled(c: Column) -> Column:
    """Trimmed text, null if blank."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def sequence(ident: Column) -> tuple[Column, Column]:
    """(producer, number) of an identifier; number is null where it isn't a producer's sequence.

    The form is part of the producer, so that producer and number together give
    back the identifier, and different identifiers never meet. Hexadecimal
    numbers are unsigned 64-bit values kept as the same bits with a sign.
    """
    as_hex, as_dec = ident.rlike(HEX), ident.rlike(DECIMAL)
    number = F.when(as_hex, F.conv(F.regexp_extract(ident, HEX, 2), 16, -10).cast("bigint")).when(as_dec, F.regexp_extract(ident, DECIMAL, 2).cast("bigint"))
    producer = F.when(as_hex, F.concat(F.lit("x"), F.regexp_extract(ident, HEX, 1))).when(as_dec, F.concat(F.lit("d"), F.regexp_extract(ident, DECIMAL, 1)))
    return F.coalesce(producer, ident), number


def identify(df: DataFrame, ident: Column, scope: Column, order: Column) -> DataFrame:
    """(producer, number, scope, order_id) of the rows that have an identity.

    number is null for identifiers that take the keyed lookup.
    """
    producer, number = sequence(F.col("ident"))
    rows = df.select(filled(ident).alias("ident"), scope.alias("scope"), order.cast("bigint").alias("order_id"))
    rows = rows.filter(F.col("ident").isNotNull() & F.col("scope").isNotNull())
    return rows.select(producer.alias("producer"), number.alias("number"), "scope", "order_id")


def superfluous(rows: DataFrame) -> DataFrame:
    """(keep_id, drop_id) for every row that repeats a message.

    Each number (or malformed identifier) is accepted once, at its least order
    value: an aggregation with map-side combining, so a message repeated in a
    third of all rows reaches its reducer as one row per map task. Only messages
    with more than one copy are joined back, by the whole key.
    """
    keys = ["producer", "number", "scope"]
    first = rows.groupBy(*keys).agg(F.min("order_id").alias("keep_id"), F.max("order_id").alias("last_id")).filter(F.col("last_id") > F.col("keep_id"))
    r, f = rows.alias("r"), first.alias("f")
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    return r.join(f, on).filter(F.col("r.order_id") > F.col("f.keep_id")).select(F.col("f.keep_id").alias("keep_id"), F.col("r.order_id").alias("drop_id"))


def merge_ranges(ranges: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Disjoint, maximal (keys, lo, hi) from any (keys, lo, hi) of whole numbers.

    Edges are reduced to one row a place, with how many ranges begin and end
    there, and summed up in order: inside blocks of places first, then over the
    blocks' sums, so that a producer with very many ranges is spread over its
    blocks and a range of any length is two rows.
    """
    r = ranges.filter(F.col("lo") <= F.col("hi"))
    edges = r.select(*keys, F.col("lo").alias("at"), F.lit(1).alias("d")).unionByName(r.select(*keys, (F.col("hi") + 1).alias("at"), F.lit(-1).alias("d")))
    steps = edges.groupBy(*keys, "at").agg(F.sum("d").alias("d")).filter("d <> 0")
    steps = steps.withColumn("_b", F.expr(f"at div {block} - if(at % {block} < 0, 1, 0)"))
    inner, outer = Window.partitionBy(*keys, "_b").orderBy("at"), Window.partitionBy(*keys).orderBy("_b")
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = steps.groupBy(*keys, "_b").agg(F.sum("d").alias("_all")).select(*keys, "_b", F.coalesce(F.sum("_all").over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    depth = steps.withColumn("_in", F.sum("d").over(upto)).join(bases, [*keys, "_b"]).withColumn("depth", F.col("_base") + F.col("_in"))
    opens = (F.col("depth") > 0) & (F.col("depth") == F.col("d"))
    marks = depth.filter(opens | (F.col("depth") == 0)).select(*keys, "at", opens.alias("opens"))
    ends = Window.partitionBy(*keys).orderBy("at")
    return marks.withColumn("hi", F.lead("at").over(ends) - 1).filter("opens").select(*keys, F.col("at").alias("lo"), "hi")


def _islands(ranges: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = ranges.withColumn("_new", F.when(reach.isNull() | (F.col("lo") - reach > 1), 1).otherwise(0))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def number_ranges(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Disjoint ranges of the numbers in rows."""
    once = rows.filter(F.col(number).isNotNull()).groupBy(*keys, number).agg(F.lit(0).alias("_"))
    return merge_ranges(once.select(*keys, F.col(number).cast("bigint").alias("lo"), F.col(number).cast("bigint").alias("hi")), keys)


def range_pieces(numbers: DataFrame) -> list[DataFrame]:
    """Written tables of (producer, scope, level, block, lo, hi) from distinct (producer, scope, number) rows.

    A level's numbers are merged inside their blocks, so no task sees more than
    2^BITS numbers of a group; full blocks are the next level's numbers.
    """
    out, level = [], 0
    current = numbers.select("producer", "scope", F.col("number").alias("n"))
    while True:
        keys = ["producer", "scope", "block"]
        blocks = current.withColumn("block", F.shiftright("n", BITS))
        w = Window.partitionBy(*keys).orderBy("n")
        runs = blocks.withColumn("_run", F.col("n").bitwiseAND(F.lit((1 << BITS) - 1)) - F.row_number().over(w))
        merged = runs.groupBy(*keys, "_run").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).drop("_run")
        full = F.col("hi") - F.col("lo") == (1 << BITS) - 1
        table, found = cut_counted(merged.select("producer", "scope", F.lit(level).alias("level"), "block", "lo", "hi"), "pieces", full=F.count_if(full))
        if not found["full"]:
            return [*out, table]
        out.append(table.filter(~full))
        current, level = table.filter(full).select("producer", "scope", F.col("block").alias("n")), level + 1


class SeenMessages:
    """What has been accepted so far: ranges per producer, and a table of malformed identifiers.

    Each delivery adds a folder of range pieces and of identifiers, and a
    manifest that lists the folders in force; nothing that is there is written
    again, until max_deltas folders are merged into one. A manifest is written
    under another name and then renamed, so a job that dies half-way leaves the
    former version in force. Producers with very many deliveries are spread by
    producer, scope and block.
    """

    RANGES = "producer string, scope string, level int, block bigint, lo bigint, hi bigint"
    LOOKUP = "producer string, scope string"

    def __init__(self, spark: SparkSession, path: str | None = None, max_deltas: int = MAX_DELTAS) -> None:
        self.spark, self.path, self.max_deltas = spark, path or fresh_path(spark, "seen"), max_deltas
        self.manifest = Manifest(spark, self.path)
        stored = self.manifest.newest() if path else None
        self.folders, self.levels = (stored["folders"], stored["levels"]) if stored else ([], [])

    def _read(self, kind: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}/{kind}" for f in self.folders]) if self.folders else self.spark.createDataFrame([], schema)

    def pieces(self) -> DataFrame:
        return self._read("ranges", self.RANGES)

    def lookup(self) -> DataFrame:
        return self._read("lookup", self.LOOKUP)

    def ranges(self) -> DataFrame:
        """(producer, scope, lo, hi): the disjoint, maximal ranges of numbers."""
        spans = self.pieces().select("producer", "scope", *[F.expr(e) for e in ("shiftleft(lo, level * 8) AS lo", "shiftleft(hi, level * 8) + (shiftleft(1L, level * 8) - 1) AS hi")])
        return _stitched(spans, ["producer", "scope"])

    def uncovered(self, rows: DataFrame) -> DataFrame:
        """The rows of this batch that carry an uncovered message, one each (the least order value)."""
        first = rows.groupBy("producer", "number", "scope").agg(F.min("order_id").alias("order_id"))
        by_number, by_key = first.filter(F.col("number").isNotNull()), first.filter(F.col("number").isNull())
        for level in self.levels:
            n = by_number.withColumns({"_at": F.shiftright("number", BITS * level), "_b": F.shiftright("number", BITS * (level + 1))}).alias("n")
            s = self.pieces().filter(F.col("level") == level).alias("s")
            covered = (F.col("n.producer") == F.col("s.producer")) & (F.col("n.scope") == F.col("s.scope")) & (F.col("n._b") == F.col("s.block")) & F.col("n._at").between(F.col("s.lo"), F.col("s.hi"))
            by_number = n.join(s, covered, "left_anti").drop("_at", "_b")
        fresh = by_number.unionByName(by_key.join(self.lookup(), ["producer", "scope"], "left_anti").select(first.columns))
        return cut(fresh, "accepted")

    def add(self, fresh: DataFrame) -> None:
        """Count these messages, none of which was seen, as seen."""
        folder = self._fresh()
        tables = range_pieces(fresh.filter(F.col("number").isNotNull()))
        levels = self._write(folder, tables, fresh.filter(F.col("number").isNull()).select("producer", "scope"))
        self._commit([*self.folders, folder], sorted({*self.levels, *levels}))
        if len(self.folders) > self.max_deltas:
            self.compact()

    def _fresh(self) -> str:
        return f"d{self.manifest.version + 1}-{uuid.uuid4().hex[:8]}"

    def _write(self, folder: str, tables: list[DataFrame], names: DataFrame) -> list[int]:
        for t in tables:
            t.write.mode("append").parquet(f"{self.path}/{folder}/ranges")
        names.write.mode("overwrite").parquet(f"{self.path}/{folder}/lookup")
        return list(range(len(tables)))

    def compact(self) -> None:
        """Merge all folders into one: pieces of a block that different deliveries have filled become one, or a number of the level above."""
        folder, tables, carried, level = self._fresh(), [], None, 0
        while level in self.levels or carried is not None:
            mine = self.pieces().filter(F.col("level") == level).select("producer", "scope", "block", "lo", "hi")
            mine = mine if carried is None else mine.unionByName(carried)
            merged = _islands(mine, ["producer", "scope", "block"])
            full = F.col("hi") - F.col("lo") == (1 << BITS) - 1
            table, found = cut_counted(merged.select("producer", "scope", F.lit(level).alias("level"), "block", "lo", "hi"), "pieces", full=F.count_if(full))
            tables.append(table.filter(~full))
            up = table.filter(full).select("producer", "scope", F.shiftright("block", BITS).alias("block"), F.col("block").alias("lo"), F.col("block").alias("hi"))
            carried, level = up if found["full"] else None, level + 1
        levels = self._write(folder, tables, self.lookup()) if tables else []
        if tables:
            self._commit([folder], levels)

    def accept(self, rows: DataFrame) -> DataFrame:
        """uncovered, and counted as seen."""
        fresh = self.uncovered(rows)
        self.add(fresh)
        return fresh.select("producer", "number", "scope", "order_id")

    def _commit(self, folders: list[str], levels: list[int]) -> None:
        self.manifest.publish({"folders": folders, "levels": levels})
        self.folders, self.levels = folders, levels


def _stitched(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint ranges, joined where one ends just before the next.

    Ranges are disjoint, so one begins a run if none ends just before it, and
    the run's end is found among the ends the same way: no order of all ranges
    of a key is needed to drop the inner edges. What remains is one row a run.
    """
    wide = ranges.select(*keys, *[F.col(c).cast("decimal(20, 0)").alias(c) for c in ("lo", "hi")])  # one beyond the largest long is no long
    edges = wide.select(*keys, F.col("lo").alias("at"), F.lit(1).alias("d")).unionByName(wide.select(*keys, (F.col("hi") + 1).cast("decimal(20, 0)").alias("at"), F.lit(-1).alias("d")))
    kept = edges.groupBy(*keys, "at").agg(F.sum("d").alias("d")).filter("d <> 0")
    w = Window.partitionBy(*keys).orderBy("at")
    return kept.withColumn("hi", F.lead("at").over(w) - 1).filter("d = 1").select(*keys, F.col("at").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"))


def superfluous_seen(rows: DataFrame, deliveries: int = 3) -> DataFrame:
    """superfluous by the ranges of what was seen, with the rows handed over in deliveries of rising order.

    The ranges and the lookup say which copies are accepted. As a range can't
    name the copy accepted, that one is then found by its key, in a join that
    spreads a message with very many copies.
    """
    rows = cut(rows.withColumn("k", F.concat_ws("\x1f", F.coalesce(F.col("number").cast("string"), F.lit("")), "scope", "producer")), "identified")
    seen, kept = SeenMessages(rows.sparkSession), None
    lo, hi, n = rows.agg(F.min("order_id"), F.max("order_id"), F.count(F.lit(1))).first()
    lo, hi = (lo, hi) if lo is not None else (0, 0)
    width = (hi - lo) // deliveries + 1
    for i in range(deliveries):
        fresh = seen.accept(rows.filter(F.col("order_id").between(lo + i * width, lo + (i + 1) * width - 1)))
        kept = fresh if kept is None else kept.unionByName(fresh)
    names = kept.select(F.concat_ws("\x1f", F.coalesce(F.col("number").cast("string"), F.lit("")), "scope", "producer").alias("k"), F.col("order_id").alias("keep_id"))
    found = lookup_join(rows.select("k", F.col("order_id").alias("drop_id")), names, "k", "inner", total=n)
    return found.filter(F.col("drop_id") > F.col("keep_id")).select("keep_id", "drop_id")


def first_copies(df: DataFrame, ident: Column, scope: Column, order: str) -> DataFrame:
    """df without superfluous rows: of each message the row with the least order, and all rows that have no identity.

    One aggregation, combined on the map side, that carries the kept row along;
    the result is that of taking superfluous' drop_ids away.
    """
    keyed = df.withColumns({"_i": filled(ident), "_s": scope})
    whole = F.col("_i").isNotNull() & F.col("_s").isNotNull()
    columns = [F.col(f"`{c}`") for c in df.columns]
    best = keyed.filter(whole).groupBy("_i", "_s").agg(F.min_by(F.struct(*columns), F.col(order)).alias("_r")).select("_r.*")
    return best.unionByName(keyed.filter(~whole).select(*columns))


def usage_scope() -> Column:
    request, session = filled(F.col("requestId")), filled(F.col("sessionId"))
    return F.when(request.isNotNull(), F.concat(F.lit("r"), request)).when(session.isNotNull(), F.concat(F.lit("s"), session))


def usage_identity(df: DataFrame) -> DataFrame:
    """claude_usage: same message id and request, or same id and session where there's no request."""
    return identify(df, F.col("message.id"), usage_scope(), F.col("record_id"))


def response_identity(df: DataFrame) -> DataFrame:
    """codex_records: same response id."""
    return identify(df, F.col("payload.response_id"), F.lit(""), F.col("record_id"))


__all__ = ["SeenMessages", "filled", "first_copies", "identify", "merge_ranges", "number_ranges", "response_identity", "sequence", "superfluous", "superfluous_seen", "usage_identity", "usage_scope"]
