"""Queries of the text problems, each over all documents and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagemill.llm import mixing, packing, splitting

#: Limits of a container beside its tokens: texts in it, and the share of its tokens that may bear loss.
MAX_SEGMENTS = 64
MAX_LOSS_SHARE = 7 / 8
SHARE_TOLERANCE = 0.005
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Registers a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def _limits(spark: SparkSession, folder: str) -> dict[str, int]:
    rows = spark.read.parquet(f"{folder}/text_limits.parquet").filter(F.col("limit_name").isin("container_capacity", "max_tokens", "overlap_tokens")).select("limit_name", "n_tokens").distinct()
    return {r[0]: r[1] for r in rows.collect()}


@query()
def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Three limits bind: tokens, texts, and loss-bearing tokens."""
    capacity = _limits(spark, folder)["container_capacity"]
    return packing.pack_texts(_documents(spark, folder), F.col("doc_id"), F.col("text"), capacity, MAX_SEGMENTS, int(capacity * MAX_LOSS_SHARE))


@query()
def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are."""
    capacity = _limits(spark, folder)["container_capacity"]
    each = p7_packed(spark, folder).groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("segments"), F.sum("n_loss").alias("loss"))
    return each.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"), F.sum("loss").alias("loss_tokens"), F.max("n").alias("fullest"),
        F.max("segments").alias("most_segments"), (F.sum("n") / (F.count(F.lit(1)) * capacity)).alias("fill"), F.count_if(F.col("loss") > 0.97 * int(capacity * MAX_LOSS_SHARE)).alias("full_of_loss"),
    )


@query("""SELECT (SELECT count(*) FROM documents) AS placed, 0::BIGINT AS above_tokens, 0::BIGINT AS above_segments, 0::BIGINT AS above_loss, 0::BIGINT AS torn, 0::BIGINT AS cut_needlessly, true AS filled""")
def p7_checked(spark: SparkSession, folder: str) -> DataFrame:
    """The packing against its rules: each text once and whole, no container above a limit, little left empty.

    A container above the loss limit may hold one loss-bearing text alone.
    """
    capacity = _limits(spark, folder)["container_capacity"]
    one = F.lit(1)
    packed = p7_packed(spark, folder)
    held = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.count(one).alias("s"), F.sum("n_loss").alias("l"), F.count_if(F.col("n_loss") > 0).alias("bearing"))
    full = held.agg(
        F.count_if(F.col("n") > capacity).alias("above_tokens"), F.count_if(F.col("s") > MAX_SEGMENTS).alias("above_segments"),
        F.count_if((F.col("l") > int(capacity * MAX_LOSS_SHARE)) & (F.col("bearing") > 1)).alias("above_loss"), (F.sum("n") / (F.count(one) * capacity) > 0.9).alias("filled"),
    )
    texts = packed.groupBy("doc_id").agg(F.count_if(F.col("piece") == 0).alias("firsts"), F.count(one).alias("k"), F.max("piece").alias("last"), F.sum("n_tokens").alias("n"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"))
    whole = texts.agg(F.sum("firsts").alias("placed"), F.count_if((F.col("k") != F.col("firsts") * (F.col("last") + 1)) | (F.col("n") != F.col("end") * F.col("firsts"))).alias("torn"), F.count_if((F.col("k") > F.col("firsts")) & (F.col("end") <= capacity)).alias("cut_needlessly"))
    return whole.join(full)


def _mixed(spark: SparkSession, folder: str) -> tuple:
    targets = spark.read.parquet(f"{folder}/mix_targets.parquet")
    return mixing.mix(_documents(spark, folder), F.col("doc_id"), F.col("source"), F.col("text"), targets)


@query()
def p8_mixed(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0]


@query()
def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(*_mixed(spark, folder))


@query("""WITH there AS (SELECT t.source, max(t.target_share) AS share, max(t.max_repeats) AS most FROM mix_targets t WHERE t.target_share > 0 AND t.max_repeats > 0 AND t.source IN (SELECT source FROM documents WHERE text <> '') GROUP BY 1)
SELECT source, round(share / (SELECT sum(share) FROM there), 6) AS wanted, true AS met, true AS within_repeats FROM there""")
def p8_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Each source's part of the tokens against its target, and the uses of its most used text."""
    drawn, made = _mixed(spark, folder)
    got = mixing.shares(drawn, made).filter("drawn_tokens > 0")
    # A token is used as often as the block it lies in.
    uses = drawn.groupBy("source", "block").agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.max("n").alias("uses"))
    wanted = F.col("target_share") / sum(x["share"] for x in made if x["draws"])
    out = got.join(uses, "source").select("source", F.round(wanted, 6).alias("wanted"), (F.abs(F.col("reached_share") - wanted) <= SHARE_TOLERANCE).alias("met"), (F.col("uses") <= F.col("max_repeats")).alias("within_repeats"))
    return out


@query()
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    limits = _limits(spark, folder)
    pieces = splitting.split_texts(_documents(spark, folder), F.col("doc_id"), F.col("text"), limits["max_tokens"], limits["overlap_tokens"], with_text=False)
    return pieces.filter(F.col("piece") == 0).select("doc_id")


@query()
def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    limits = _limits(spark, folder)
    return splitting.split_texts(_documents(spark, folder), F.col("doc_id"), F.col("text"), limits["max_tokens"], limits["overlap_tokens"])


@query("SELECT doc_id, md5(coalesce(text, '')) AS rebuilt, true AS within_size, true AS shared FROM documents")
def p9_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Every text put together again from its pieces, or as it is where it wasn't split."""
    limits, documents = _limits(spark, folder), _documents(spark, folder)
    pieces = p9_pieces(spark, folder).withColumn("own", F.expr("decode(substring(encode(piece_text, 'UTF-8'), cast(overlap_bytes + 1 AS int)), 'UTF-8')"))
    put = F.array_sort(F.collect_list(F.struct("piece", F.col("own").alias("t"))))
    whole = pieces.groupBy("doc_id").agg(
        F.array_join(F.transform(put, lambda p: p["t"]), "").alias("w"), (F.max("n_tokens") <= limits["max_tokens"]).alias("within_size"), F.min((F.col("piece") == 0) | (F.col("overlap") >= limits["overlap_tokens"])).alias("shared")
    )
    out = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(whole, "doc_id", "left")
    return out.select("doc_id", F.md5(F.coalesce("w", "text")).alias("rebuilt"), F.coalesce("within_size", F.lit(True)).alias("within_size"), F.coalesce("shared", F.lit(True)).alias("shared"))
