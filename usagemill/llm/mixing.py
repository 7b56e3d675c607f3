"""Mixing sources to target weights.

Each source's texts are laid end to end and cut into blocks of a fixed number
of tokens, as token ids. The output is a row of shards with a fixed number of
block slots; how many slots of a shard go to each source is drawn at random, and
slot by slot the source's next draw is mapped through a pseudorandom permutation
of its block numbers, a new one for every pass over the source. Blocks are
joined to the slots by number, so no task needs to see a whole source.

Texts are encoded once, and each task of that pass cuts the blocks of its own
texts. What is left over of a source in a task is less than a block; these rests,
one a task and source, are laid end to end and cut afterwards. So texts aren't
moved to be cut, a source that holds most of the rows is spread over all tasks,
and only the last block of a source is shorter than the others.

The draws of all shards are multinomial, given that their sums hit the targets:
a shard finds its own counts, and how many draws lie before it, by walking down
a binary tree of seeded splits of the totals. Splits are hypergeometric draws;
beyond what the generator takes (_EXACT), draws of a normal variable of the same
mean and variance, cut to what is possible. A source's blocks are used once per
pass and at most max_repeats passes are made, so no text is used more often.

Defined results
    total size            given, or the largest at which every target can be met
    a target without documents, or with a share or repeat limit of 0 or null
                          gets nothing and is reported; the others keep their
                          proportions
    a source without target, a null source
                          not drawn
    a null or empty text  has no tokens and is never drawn
    equal rows            each counts as a text of its own
    empty input           an empty draw; shares report 0
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagemill.llm.tokens import DEFAULT_VOCABULARY, tokenizer
from usagemill.session import cut

BLOCK_TOKENS = 512
SHARD_SLOTS = 256
MAX_BASES = 1_000_000
#: Fixed value: the generator's hypergeometric draws take populations below 1e9.
_EXACT = 900_000_000
_FLUSH_TOKENS = 262_144
_PART = "struct<doc_id: bigint, first_token: bigint, n_tokens: bigint>"
_PLACED = f"array<struct<x: {_PART}, at: bigint>>"
_BLOCKS = f"part int, source string, k bigint, n_tokens bigint, tokens array<int>, parts array<{_PART}>"
_PART_SCHEMA = pa.struct([("doc_id", pa.int64()), ("first_token", pa.int64()), ("n_tokens", pa.int64())])
_BLOCK_SCHEMA = pa.schema([("part", pa.int32()), ("source", pa.string()), ("k", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32())), ("parts", pa.list_(_PART_SCHEMA))])
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..size-1, at any index without a table (Feistel rounds, walking cycles)."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        keys = [_scramble(np.array([key & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64) + _GOLD * np.uint64(r + 1))[0] for r in range(4)]
        while len(todo):
            x = out[todo]
            left, right = x >> shift, x & mask
            for k in keys:
                left, right = right, left ^ (_scramble(right + k) & mask)
            out[todo] = (left << shift) | right
            todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


def _split(total: np.ndarray, slots: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each source's draws fall into the first slots of a node."""
    whole = int(total.sum())
    if whole < _EXACT:
        return rng.multivariate_hypergeometric(total, slots, method="marginals")
    out = np.zeros_like(total)
    rest, wanted = whole, slots
    for i, n in enumerate(total.tolist()):
        if rest <= n:
            out[i] = wanted
            break
        out[i] = _of_many(n, rest, wanted, rng)
        rest, wanted = rest - n, wanted - int(out[i])
    return out


def _of_many(good: int, whole: int, wanted: int, rng: np.random.Generator) -> int:
    """How many of wanted draws without return from whole are among the good ones."""
    if whole < _EXACT:
        return int(rng.hypergeometric(good, whole - good, wanted))
    share, taken = good / whole, wanted / whole
    spread = (wanted * share * (1 - share) * (1 - taken) * whole / (whole - 1)) ** 0.5
    off = int(round(rng.standard_normal() * spread))
    return max(wanted - (whole - good), min(good, wanted, max(0, good * wanted // whole + off)))


def shard_draws(quota: np.ndarray, shard: int, shards: int, slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(draws before the shard, draws in it) per source. Shards are alike to whoever computes them."""
    lo, hi, before, here = 0, shards, np.zeros_like(quota), quota.copy()
    while hi - lo > 1:
        mid = (lo + hi) // 2
        first = _split(here, min(int(here.sum()), (mid - lo) * slots), np.random.default_rng([seed, lo, hi]))
        if shard < mid:
            hi, here = mid, first
        else:
            lo, before, here = mid, before + first, here - first
    return before, here


class _Row:
    """A task's texts of one source, end to end: the part that isn't in a block yet."""

    __slots__ = ("ids", "parts", "cut")

    def __init__(self) -> None:
        self.ids, self.parts, self.cut = [], [], 0

    def add(self, doc_id: int | None, ids: list[int], block: int) -> Iterator[tuple[list[int], list[tuple]]]:
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, block - len(self.ids))
            self.ids += ids[at : at + n]
            self.parts.append({"doc_id": doc_id, "first_token": at, "n_tokens": n})
            at += n
            if len(self.ids) == block:
                yield self.ids, self.parts
                self.ids, self.parts, self.cut = [], [], self.cut + 1


def encoded(df: DataFrame, doc_id: Column, source: Column, text: Column, block: int, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(part, source, k, n_tokens, tokens, parts): each task's blocks, numbered per source by k, and its rests, whose k is -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, task = tokenizer(vocabulary), TaskContext.get()
        part, open_, out = task.partitionId() if task else 0, {}, []

        def flush() -> pa.RecordBatch:
            source, k, ids, parts = zip(*out) if out else ([], [], [], [])
            columns = [[part] * len(out), source, k, [len(x) for x in ids], ids, parts]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCK_SCHEMA)], schema=_BLOCK_SCHEMA)

        for b in batches:
            for x, name, i in zip(b.column(2), b.column(1).to_pylist(), b.column(0).to_pylist()):
                if x.is_valid:
                    row = open_.setdefault(name, _Row())
                    for ids, parts in row.add(i, t.core.encode_ordinary(x.as_py()), block):
                        out.append((name, row.cut, ids, parts))
                        if len(out) * block >= _FLUSH_TOKENS:
                            yield flush()
        out += [(name, -1, row.ids, row.parts) for name, row in open_.items() if row.ids]
        yield flush()

    three = df.select(doc_id.cast("bigint").alias("doc_id"), source.cast("string").alias("source"), text.alias("text"))
    return three.mapInArrow(run, _BLOCKS)


def numbered(made: DataFrame, block: int) -> DataFrame:
    """(source, block, n_tokens, tokens, parts): all blocks, numbered from 0 in each source.

    A task's blocks come after those of the tasks before, and behind them all
    come the blocks cut from the rests.
    """
    counts = made.groupBy("source", "part").agg(F.count_if(F.col("k") >= 0).alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(Window.partitionBy("source"))
    bases = cut(counts.select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), total.alias("total")), "bases")
    # One row per task and source: broadcast while that is few, whatever the texts come to.
    bases = F.broadcast(bases) if bases.limit(MAX_BASES + 1).count() <= MAX_BASES else bases.hint("shuffle_merge")
    placed = made.join(bases, ["source", "part"])
    shown = ["source", "block", "n_tokens", "tokens", "parts"]
    full = placed.filter("k >= 0").withColumn("block", F.col("base") + F.col("k")).select(*shown)
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rests = placed.filter("k < 0").withColumn("offset", F.coalesce(F.sum("n_tokens").over(upto), F.lit(0)))
    # A rest reaches over two blocks at most, as it is shorter than one.
    first, last = F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("n_tokens") - 1) / block)
    each = F.explode(F.transform(F.sequence(first, last), lambda b: _piece(b, block)))
    cuts = rests.select("source", "total", each.alias("e")).groupBy("source", F.col("e.block").alias("b"), "total").agg(F.array_sort(F.collect_list("e")).alias("p"))
    flat = lambda name: F.flatten(F.transform("p", lambda x: x[name]))
    short = cuts.select("source", (F.col("total") + F.col("b")).alias("block"), F.size(flat("tokens")).cast("bigint").alias("n_tokens"), flat("tokens").alias("tokens"), flat("parts").alias("parts"))
    return full.unionByName(short)


def _piece(b: Column, block: int) -> Column:
    """What of a rest lies in block b: its ids, and the parts of texts cut to it."""
    start = F.greatest(F.lit(0), b * block - F.col("offset")).cast("int")
    stop = F.least(F.col("n_tokens"), (b + 1) * block - F.col("offset")).cast("int")
    # Each part with the place at which it begins in the rest.
    placed = F.aggregate("parts", F.array().cast(_PLACED), lambda got, x: F.concat(got, F.array(F.struct(x.alias("x"), _end(got).alias("at")))))
    lo = lambda y: F.greatest(start, y["at"])
    hi = lambda y: F.least(stop, y["at"] + y["x"]["n_tokens"])
    own = F.filter(placed, lambda y: lo(y) < hi(y))
    parts = F.transform(own, lambda y: F.struct(y["x"]["doc_id"].alias("doc_id"), (y["x"]["first_token"] + lo(y) - y["at"]).alias("first_token"), (hi(y) - lo(y)).cast("bigint").alias("n_tokens")))
    return F.struct(b.alias("block"), F.col("offset").alias("offset"), F.slice("tokens", start + 1, stop - start).alias("tokens"), parts.alias("parts"))


def _end(got: Column) -> Column:
    last = F.try_element_at(got, F.lit(-1))
    return F.coalesce(last["at"] + last["x"]["n_tokens"], F.lit(0)).cast("bigint")


def plan(made: DataFrame, targets: DataFrame, block: int, total_tokens: int | None) -> list[dict]:
    """Per target: blocks there are, blocks to draw. targets has (source, target_share, max_repeats).

    The targets are part of the request: there is a row for each on the driver
    and in each task, whatever the texts come to.
    """
    wanted = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).collect()
    begun = F.size(F.filter("parts", lambda p: p["first_token"] == 0))
    has = made.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.sum(begun).alias("docs")).join(targets.select("source").distinct(), "source").collect()
    there = {r["source"]: (r["n"] or 0, r["docs"]) for r in has}
    out = []
    for r in sorted(wanted, key=lambda r: (r["source"] is None, r["source"])):
        tokens, docs = there.get(r["source"], (0, 0))
        out.append({"source": r["source"], "share": r["target_share"] or 0.0, "repeats": r["max_repeats"] or 0, "tokens": tokens, "docs": docs, "blocks": -(-tokens // block)})
    open_ = [x for x in out if x["share"] > 0 and x["repeats"] > 0 and x["tokens"] > 0]
    size = min((x["tokens"] * x["repeats"] / x["share"] for x in open_), default=0.0)
    if total_tokens is not None:
        size = min(size, total_tokens / max(1e-12, sum(x["share"] for x in open_)))
    for x in out:
        mean = x["tokens"] / x["blocks"] if x["blocks"] else 1
        x["draws"] = min(x["blocks"] * x["repeats"], int(round(size * x["share"] / mean))) if x in open_ else 0
    return out


def mix(df: DataFrame, doc_id: Column, source: Column, text: Column, targets: DataFrame, block: int = BLOCK_TOKENS, slots: int = SHARD_SLOTS, total_tokens: int | None = None, seed: int = 7, vocabulary: str = DEFAULT_VOCABULARY) -> tuple[DataFrame, list[dict]]:
    """The drawn set, one row per filled slot with its block of token ids, and the plan it was drawn by."""
    # Sources without a target are left out before anything is encoded; an unknown size of targets is no broadcast.
    wanted = targets.filter(F.col("source").isNotNull()).select(F.col("source").cast("string").alias("source")).distinct()
    rows = df.select(doc_id.alias("doc_id"), source.cast("string").alias("source"), text.alias("text")).join(wanted, "source", "left_semi")
    used = cut(encoded(rows, F.col("doc_id"), F.col("source"), F.col("text"), block, vocabulary), "blocks")
    made = plan(used, targets, block, total_tokens)
    drawn = [x for x in made if x["draws"]]
    quota = np.array([x["draws"] for x in drawn], dtype=np.int64)
    blocks = [x["blocks"] for x in drawn]
    names = [x["source"] for x in drawn]
    shards = int(-(-quota.sum() // slots)) if len(drawn) else 0

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for shard in f["id"]:
                before, here = shard_draws(quota, int(shard), shards, slots, seed)
                src = np.repeat(np.arange(len(names)), here)
                ordinal = np.concatenate([np.arange(b, b + n) for b, n in zip(before, here)]) if len(src) else np.zeros(0, dtype=np.int64)
                n = np.array(blocks, dtype=np.int64)[src]
                run, at = ordinal // n, ordinal % n
                block_no = np.zeros(len(src), dtype=np.int64)
                for s, e in {(int(a), int(b)) for a, b in zip(src, run)}:
                    m = (src == s) & (run == e)
                    block_no[m] = permute(at[m], blocks[s], (seed << 40) ^ (s << 20) ^ e)
                slot = np.random.default_rng([seed, 1, int(shard)]).permutation(len(src))
                yield pd.DataFrame({"shard": int(shard), "slot": slot.astype(np.int32), "source": [names[i] for i in src], "pass": run.astype(np.int32), "block": block_no})

    spark = df.sparkSession
    picks = spark.range(0, shards, 1, max(1, min(shards, spark.sparkContext.defaultParallelism * 4))).mapInPandas(draw, "shard bigint, slot int, source string, pass int, block bigint")
    # Both sides grow with the texts, and the slots' size can't be estimated: never a broadcast.
    joined = picks.hint("shuffle_merge").join(numbered(used, block), ["source", "block"])
    return joined.select("shard", "slot", "source", "pass", "block", "n_tokens", "tokens", "parts"), made


def shares(drawn: DataFrame, made: list[dict]) -> DataFrame:
    """Target and reached share of each target source."""
    spark = drawn.sparkSession
    got = drawn.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.max("pass").alias("last"))
    rows = [(x["source"], float(x["share"]), int(x["repeats"]), int(x["docs"]), int(x["tokens"])) for x in made]
    base = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, documents bigint, available_tokens bigint")
    joined = base.join(got, "source", "left")
    tokens = F.coalesce("tokens", F.lit(0))
    whole = F.sum(tokens).over(Window.partitionBy())
    return joined.select("source", "target_share", "max_repeats", "documents", "available_tokens", tokens.alias("drawn_tokens"), F.when(whole > 0, tokens / whole).otherwise(F.lit(0.0)).alias("reached_share"), F.coalesce(F.col("last") + 1, F.lit(0)).alias("passes"))
