"""Schemas that drift between files: one table for all, and a report of each change.

Each file is a version of its stream's schema. Its columns are profiled (type,
rows, a theta sketch of the values), consecutive versions are compared, and
columns that went are matched with columns that came by a maximum-weight
bipartite matching over name, type and value similarity. A matched pair that is
similar enough is a rename. Given paths, only these are profiled; without, every
column of every line is: the fields of objects at any depth, found by the shapes
lines have, and only the columns of a file that went or came are sketched.
narrowed() gives the part of such a report that concerns some paths.
The renames found link paths to columns: each column
of the unified table is named by one or more seed paths, and takes the values of
all tracked paths that renames lead to from there. The strongest links are taken
first, and none that would join two columns.

Defined results
    a line that isn't a JSON object   counts for no path, its file still exists
    null values                       the path isn't there on that line
    several types in one file         the commonest, ties by name
    repeated lines                    count as they come
    gaps in the file sequence         the next lower file present is the former
    a tracked path without a link     isn't in any column; links() tells which
    elements of an array              are values of the array, not columns
    a key with a dot or a quote       is one part of its path, written as a JSON string
    an array of one value             that value in the unified table
    empty input                       empty results; the seeds' columns, all null
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagemill.operators.skew import lag_in_blocks
from usagemill.session import cut

FILES_PER_BLOCK = 256
MIN_SCORE = 0.5
#: A sketch counts up to 2^SKETCH_BITS different values of a column in a file exactly.
SKETCH_BITS = 8
_KINDS = {"STRING": "string", "BOOLEAN": "boolean", "OBJECT": "object", "ARRAY": "array"}
_FILE = ["stream", "seq", "src_file"]
_TOKEN = re.compile(r"`(?:[^`]|``)*`|\w+(?:\([\d, ]*\))?|[<>:,]")


def _kind(value: Column) -> Column:
    """string, number, boolean, object or array of a variant; null for null."""
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    out = F.when(value.isNull() | F.is_variant_null(value), F.lit(None).cast("string"))
    for raw, kind in _KINDS.items():
        out = out.when(name == raw, kind)
    return out.otherwise("number")


def _pick(path: str) -> Column:
    return F.try_variant_get("_v", "$" + "".join(f".{p}" for p in path.split(".")), "variant")


def values_at(lines: DataFrame, raw: str, paths: list[str]) -> DataFrame:
    """lines with _at: an array of (path, type, value) of the tracked paths that are there."""
    rows = lines.withColumn("_v", F.try_parse_json(F.col(raw)))
    found = []
    for path in paths:
        v = _pick(path)
        text = F.coalesce(F.try_variant_get("_v", "$" + "".join(f".{p}" for p in path.split(".")), "string"), F.to_json(v))
        kind = _kind(v)
        found.append(F.when(kind.isNotNull(), F.struct(F.lit(path).alias("path"), kind.alias("type"), text.alias("value"))))
    return rows.withColumn("_at", F.filter(F.array(*found), lambda e: e.isNotNull())).drop("_v")


def _keyed(lines: DataFrame, stream: str, seq: str, file: str, raw: str) -> DataFrame:
    return lines.select(F.col(stream).alias("stream"), F.col(seq).cast("bigint").alias("seq"), F.col(file).alias("src_file"), F.col(raw).alias("raw"))


def profiles(lines: DataFrame, stream: str, seq: str, file: str, raw: str, paths: list[str]) -> DataFrame:
    """One row per file: (stream, seq, src_file, columns), columns being an array of (path, type, rows, sketch)."""
    at = values_at(_keyed(lines, stream, seq, file, raw), "raw", paths)
    each = at.select("stream", "seq", "src_file", F.explode_outer("_at").alias("e")).select("stream", "seq", "src_file", "e.*")
    typed = each.groupBy("stream", "seq", "src_file", "path", "type").agg(F.count("value").alias("rows"), F.theta_sketch_agg("value", SKETCH_BITS).alias("sketch"))
    column = F.struct(F.col("rows"), F.col("type"), F.col("path"), F.col("sketch"))
    merged = typed.groupBy("stream", "seq", "src_file", "path").agg(F.max_by(column, F.struct(F.col("rows"), F.col("type"))).alias("c"))
    per_file = merged.groupBy("stream", "seq", "src_file").agg(F.collect_list(F.when(F.col("path").isNotNull(), F.struct("c.path", "c.type", "c.rows", "c.sketch"))).alias("columns"))
    return per_file


def path_of(keys: list[str]) -> str:
    """Keys joined by dots; a key that isn't plain is written as a JSON string, so that no two columns share a path."""
    return ".".join(k if k and not set(k) & {".", '"'} else json.dumps(k, ensure_ascii=False) for k in keys)


def _keys_of(path: Column) -> Column:
    """The keys path_of joined."""
    parts = F.regexp_extract_all(path, F.lit(r'("(?:[^"\\]|\\.)*"|[^."]+)'), F.lit(1))
    return F.transform(parts, lambda p: F.when(p.startswith('"'), F.get(F.from_json(F.concat(F.lit("["), p, F.lit("]")), "array<string>"), F.lit(0))).otherwise(p))


@lru_cache(maxsize=4096)
def columns_of(shape: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Paths and types of the columns of an object, from its schema_of_variant; those that are null aren't there."""
    paths, kinds, keys, inside, arrays, at_name = [], [], [], [], 0, False
    tokens = _TOKEN.findall(shape)
    i = 0
    while i < len(tokens):
        t, ends = tokens[i], False
        if t == ">":
            arrays -= inside.pop() == "ARRAY"
            ends = True
        elif t == ",":
            at_name = True
        elif at_name:
            if not arrays:
                keys.append(t[1:-1].replace("``", "`") if t[0] == "`" else t)
            at_name = False
            i += 1  # the colon
        else:
            if keys and not arrays and t != "VOID":
                paths.append(path_of(keys))
                kinds.append(_KINDS.get(t, "number"))
            if tokens[i + 1 : i + 2] == ["<"]:
                inside.append(t)
                arrays += t == "ARRAY"
                at_name = t == "OBJECT" and tokens[i + 2] != ">"
                i += 1
            else:
                ends = True
        if ends and keys and not arrays:
            keys.pop()
        i += 1
    return tuple(paths), tuple(kinds)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per file in a batch, with its columns' (path, type, rows)."""
    for batch in batches:
        files: dict[tuple, tuple[int, dict]] = {}
        names = [batch.column(c).to_pylist() for c in (*_FILE, "shape", "n")]
        for i, (stream, seq, file, shape, n) in enumerate(zip(*names)):
            _, at = files.setdefault((stream, seq, file), (i, {}))
            for column in zip(*columns_of(shape)) if shape is not None else ():
                at[column] = at.get(column, 0) + n
        first = pa.array([i for i, _ in files.values()], pa.int64())
        ends, flat = [0], [(p, t, n) for _, at in files.values() for (p, t), n in at.items()]
        for _, at in files.values():
            ends.append(ends[-1] + len(at))
        paths, kinds, rows = zip(*flat) if flat else ((), (), ())
        each = pa.StructArray.from_arrays([pa.array(paths, pa.string()), pa.array(kinds, pa.string()), pa.array(rows, pa.int64())], ["path", "type", "rows"])
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(first) for c in _FILE), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)], [*_FILE, "at"])


def all_profiles(lines: DataFrame, stream: str, seq: str, file: str, raw: str) -> DataFrame:
    """profiles of every column, without sketches: lines are counted by their shape, and each shape is taken apart."""
    shape = F.schema_of_variant(F.try_parse_json(F.col("raw")))
    shaped = _keyed(lines, stream, seq, file, raw).select(*_FILE, F.when(shape.startswith("OBJECT<"), shape).alias("shape"))
    counted = shaped.groupBy(*_FILE, "shape").agg(F.count(F.lit(1)).alias("n")).repartition(*_FILE)
    at = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("type", T.StringType()), T.StructField("rows", T.LongType())]))
    walked = counted.mapInArrow(_walk, T.StructType([*(counted.schema[c] for c in _FILE), T.StructField("at", at)]))
    each = walked.repartition(*_FILE).select(*_FILE, F.explode_outer("at").alias("e")).select(*_FILE, "e.*")
    typed = each.groupBy(*_FILE, "path", "type").agg(F.sum("rows").alias("rows"))
    merged = typed.groupBy(*_FILE, "path").agg(F.max(F.struct("rows", "type")).alias("c"))
    return merged.groupBy(*_FILE).agg(F.collect_list(F.when(F.col("path").isNotNull(), F.struct("path", "c.type", "c.rows"))).alias("columns"))


def sketched(changed: DataFrame, lines: DataFrame, stream: str, seq: str, file: str, raw: str) -> DataFrame:
    """The versions in which columns both went and came, with sketches of these columns."""
    both = changed.filter((F.size("gone") > 0) & (F.size("came") > 0))
    side = lambda new, s, f, c: both.select("stream", F.col(s).alias("seq"), F.col(f).alias("src_file"), F.lit(new).alias("new"), F.explode(c).alias("c"))
    wanted = side(False, "prev_seq", "prev_src_file", "gone").unionByName(side(True, "seq", "src_file", "came"))
    wanted = wanted.groupBy(*_FILE).agg(F.collect_list(F.struct("new", "c.path", "c.type", _keys_of(F.col("c.path")).alias("keys"))).alias("wanted"))
    same = lambda a, b: a["stream"].eqNullSafe(b["stream"]) & a["seq"].eqNullSafe(b["seq"]) & a["src_file"].eqNullSafe(b["src_file"])
    rows = _keyed(lines, stream, seq, file, raw)
    rows = rows.join(wanted, same(rows, wanted)).select(*(rows[c] for c in _FILE), F.try_parse_json(rows["raw"]).alias("v"), F.explode("wanted").alias("w"))
    rows = rows.select(*_FILE, "w", F.expr("aggregate(w.keys, v, (x, k) -> try_cast(x as map<string, variant>)[k])").alias("v")).filter(_kind(F.col("v")) == F.col("w.type"))
    text = F.coalesce(F.try_variant_get("v", "$", "string"), F.to_json("v"))
    each = rows.groupBy(*_FILE, "w.new", "w.path", "w.type").agg(F.theta_sketch_agg(text, SKETCH_BITS).alias("sketch"))
    found = each.groupBy(*_FILE, "new").agg(F.collect_list(F.struct("path", "type", "sketch")).alias("columns"))
    old, new = found.filter(~F.col("new")).alias("o"), found.filter("new").alias("n")
    at = lambda a, s, f: F.col("b.stream").eqNullSafe(F.col(f"{a}.stream")) & F.col(f"b.{s}").eqNullSafe(F.col(f"{a}.seq")) & F.col(f"b.{f}").eqNullSafe(F.col(f"{a}.src_file"))
    out = both.alias("b").join(old, at("o", "prev_seq", "prev_src_file")).join(new, at("n", "seq", "src_file"))
    return out.select("b.src_file", F.col("o.columns").alias("gone"), F.col("n.columns").alias("came"))


def versions(profile: DataFrame) -> DataFrame:
    """Each file with the columns of the one before it in its stream; first files are left out."""
    block = F.floor(F.col("seq") / FILES_PER_BLOCK)
    tagged = lag_in_blocks(profile, ["stream"], "seq", block, ["seq", "src_file", "columns"])
    rows = tagged.filter(F.col("prev_seq").isNotNull())
    has = lambda side: (lambda e: F.exists(side, lambda o: o["path"] == e["path"]))
    gone = F.filter("prev_columns", lambda e: ~has(F.col("columns"))(e))
    came = F.filter("columns", lambda e: ~has(F.col("prev_columns"))(e))
    kept = F.filter("columns", lambda e: F.exists("prev_columns", lambda o: (o["path"] == e["path"]) & (o["type"] != e["type"])))
    return rows.select("stream", "seq", "src_file", "prev_seq", "prev_src_file", gone.alias("gone"), came.alias("came"), F.transform(kept, lambda e: e["path"]).alias("retyped"))


@lru_cache(maxsize=4096)
def _grams(name: str) -> frozenset[str]:
    name = name.lower().replace("_", ".")
    return frozenset(f"  {name} "[i : i + 3] for i in range(len(name) + 1))


def name_similarity(a: str, b: str) -> float:
    """Share of common character trigrams of two dotted names."""
    x, y = _grams(a), _grams(b)
    both = len(x & y)
    return both / max(1, len(x) + len(y) - both)


def best_matching(weight: list[list[float]]) -> list[tuple[int, int]]:
    """A maximum-weight matching of rows to columns (shortest augmenting paths over potentials)."""
    w = np.asarray(weight, dtype=float)
    if w.size == 0:
        return []
    n, m = w.shape
    if n > m:
        return [(i, j) for j, i in best_matching(w.T)]
    if n == 1:
        return [(0, int(w[0].argmax()))]
    u, v, owner, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            cost = -w[owner[j0] - 1] - u[owner[j0]] - v[1:]
            closer = ~used[1:] & (cost < least[1:])
            least[1:][closer] = cost[closer]
            way[1:][closer] = j0
            j1 = int(np.where(used[1:], np.inf, least[1:]).argmin()) + 1
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


def _match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        out = []
        for file, gone, came, overlap in zip(pdf["src_file"], pdf["old"], pdf["new"], pdf["overlap"]):
            score = lambda a, b, j: (name_similarity(a["path"], b["path"]) + (a["type"] == b["type"]) + (0.0 if j is None else j)) / 3
            weight = [[score(a, b, j) for b, j in zip(came, js)] for a, js in zip(gone, overlap)]
            for i, j in best_matching(weight):
                out.append((file, gone[i]["path"], came[j]["path"], weight[i][j], len(gone), len(came)))
        yield pd.DataFrame(out, columns=["src_file", "old_path", "new_path", "score", "n_gone", "n_came"])


def matches(changed: DataFrame) -> DataFrame:
    """(src_file, old_path, new_path, score, n_gone, n_came) of matched columns."""
    ordered = lambda c: F.array_sort(c, lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0)).alias(c)
    both = changed.filter((F.size("gone") > 0) & (F.size("came") > 0)).select("src_file", ordered("gone"), ordered("came"))
    pairs = F.transform("gone", lambda a: F.transform("came", lambda b: _jaccard(a["sketch"], b["sketch"])))
    slim = lambda c: F.transform(c, lambda e: F.struct(e["path"].alias("path"), e["type"].alias("type")))
    ready = both.select("src_file", slim("gone").alias("old"), slim("came").alias("new"), pairs.alias("overlap"))
    return ready.mapInPandas(_match, "src_file string, old_path string, new_path string, score double, n_gone bigint, n_came bigint")


def _jaccard(a: Column, b: Column) -> Column:
    both, either = F.theta_sketch_estimate(F.theta_intersection(a, b)), F.theta_sketch_estimate(F.theta_union(a, b))
    return both / F.greatest(either, F.lit(1)).cast("double")


def renames(changed: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(src_file, old_path, new_path, score) of the matched pairs that are similar enough."""
    return matches(changed).filter(F.col("score") >= min_score).select("src_file", "old_path", "new_path", "score")


def links(found: DataFrame) -> list[tuple[str, str, int, float]]:
    """(path, path, files, mean score) of renames in either direction, most files first; a row for each pair of tracked paths at most."""
    a, b = F.least("old_path", "new_path"), F.greatest("old_path", "new_path")
    rows = found.groupBy(a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score")).collect()
    return sorted(((r.a, r.b, r.n, r.score) for r in rows), key=lambda r: (-r[2] * r[3], r[0], r[1]))


def columns_by_links(seeds: dict[str, list[str]], paths: list[str], found: list[tuple[str, str, int, float]]) -> dict[str, list[str]]:
    """Each column's paths, in the order of paths: its seeds and what links lead to from them."""
    group = {p: p for p in [*paths, *(s for ss in seeds.values() for s in ss)]}
    column = {}

    def head(p: str) -> str:
        while group[p] != p:
            p = group[p]
        return p

    for name, own in seeds.items():
        for s in own[1:]:
            group[head(s)] = head(own[0])
        column[head(own[0])] = name
    for a, b, _, _ in found:
        x, y = head(a), head(b)
        if x != y and not (x in column and y in column):
            x, y = (y, x) if y in column else (x, y)
            group[y] = x
    return {name: [p for p in group if column.get(head(p)) == name] for name in seeds}


def changes(lines: DataFrame, stream: str, seq: str, file: str, raw: str, paths: list[str] | None, min_score: float = 0.0, sole: bool = True) -> DataFrame:
    """(src_file, change, old_path, new_path) between each file and the one before it, of the paths or, without, of every column.

    A matched pair is a rename if its score reaches min_score and, with sole,
    if no other tracked path went or came; otherwise its ends are a removal and
    an addition.
    """
    profile = cut(all_profiles(lines, stream, seq, file, raw), "profiles") if paths is None else profiles(lines, stream, seq, file, raw, paths)
    changed = cut(versions(profile).filter((F.size("gone") > 0) | (F.size("came") > 0) | (F.size("retyped") > 0)), "versions")
    renamed = matches(sketched(changed, lines, stream, seq, file, raw) if paths is None else changed).filter(F.col("score") >= min_score)
    if sole:
        renamed = renamed.filter((F.col("n_gone") == 1) & (F.col("n_came") == 1))
    renamed = renamed.select("src_file", "old_path", "new_path")
    if paths is None:
        renamed = cut(renamed, "renamed")
    by_file = renamed.groupBy("src_file").agg(F.collect_list("old_path").alias("olds"), F.collect_list("new_path").alias("news"))
    rows = changed.join(by_file, "src_file", "left")
    none = F.array().cast("array<string>")
    path = lambda c: F.transform(c, lambda e: e["path"])
    removed = F.array_except(path("gone"), F.coalesce("olds", none))
    added = F.array_except(path("came"), F.coalesce("news", none))
    item = lambda kind, old, new: F.struct(F.lit(kind).alias("change"), old.alias("old_path"), new.alias("new_path"))
    listed = F.concat(
        F.transform(removed, lambda p: item("removed", p, F.lit(""))),
        F.transform(added, lambda p: item("added", F.lit(""), p)),
        F.transform("retyped", lambda p: item("retyped", p, p)),
    )
    report = rows.select("src_file", F.explode(listed).alias("e")).select("src_file", "e.*")
    return report.unionByName(renamed.withColumn("change", F.lit("renamed")).select("src_file", "change", "old_path", "new_path"))


def narrowed(report: DataFrame, paths: list[str]) -> DataFrame:
    """The part of a report of all columns that concerns paths: renamed if exactly one of them went and exactly one came, else removed and added."""
    old, new = F.col("old_path").isin(paths), F.col("new_path").isin(paths)
    is_ = lambda *kinds: F.col("change").isin(*kinds)
    taken = lambda holds, c: F.collect_list(F.when(holds, F.col(c)))
    by_file = report.filter(old | new).groupBy("src_file").agg(
        taken(is_("removed", "renamed") & old, "old_path").alias("gone"), taken(is_("added", "renamed") & new, "new_path").alias("came"), taken(is_("retyped"), "old_path").alias("retyped")
    )
    item = lambda kind, a, b: F.struct(F.lit(kind).alias("change"), a.alias("old_path"), b.alias("new_path"))
    apart = F.concat(F.transform("gone", lambda p: item("removed", p, F.lit(""))), F.transform("came", lambda p: item("added", F.lit(""), p)))
    one = F.when((F.size("gone") == 1) & (F.size("came") == 1), F.array(item("renamed", F.get("gone", F.lit(0)), F.get("came", F.lit(0))))).otherwise(apart)
    return by_file.select("src_file", F.explode(F.concat(one, F.transform("retyped", lambda p: item("retyped", p, p)))).alias("e")).select("src_file", "e.*")


def unified(lines: DataFrame, raw: str, columns: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """All lines in one table: each column takes the first of its paths that is there, as text.

    An object gives its id or mode, where it has one, else its JSON text; an
    array of one value gives that.
    """
    rows = lines.withColumn("_v", F.try_parse_json(F.col(raw)))
    out = [F.col(k) for k in keep]
    for name, paths in columns.items():
        texts = []
        for p in paths:
            v, at = _pick(p), "$" + "".join(f".{x}" for x in p.split("."))
            kind = _kind(v)
            inner = F.coalesce(F.try_variant_get("_v", at + ".id", "string"), F.try_variant_get("_v", at + ".mode", "string"), F.to_json(v))
            texts.append(F.when(kind == "object", inner).when(kind == "array", F.coalesce(F.when(F.try_variant_get("_v", at + "[1]", "variant").isNull(), F.try_variant_get("_v", at + "[0]", "string")), F.to_json(v))).when(kind.isNotNull(), F.try_variant_get("_v", at, "string")))
        out.append(F.coalesce(*texts, F.lit(None).cast("string")).alias(name))
    return rows.select(*out)


def unified_by_matches(lines: DataFrame, stream: str, seq: str, file: str, raw: str, seeds: dict[str, list[str]], paths: list[str], keep: list[str], min_score: float = MIN_SCORE) -> DataFrame:
    """unified, with each column's paths found by the renames between the files."""
    changed = cut(versions(profiles(lines, stream, seq, file, raw, paths)).filter((F.size("gone") > 0) & (F.size("came") > 0)), "versions")
    return unified(lines, raw, columns_by_links(seeds, paths, links(renames(changed, min_score))), keep)

