"""Parent-child links to full hierarchies.

Components are found first (pointer doubling over the links), each component is
then brought together in one place and walked depth-first with node colours.
A component larger than max_component rows is never brought into one task: its
paths, depths, subtree sizes and depth-first numbers come from pointer doubling
and sums over siblings, which gives the same columns in log2(depth) distributed
steps. Siblings are visited in the order of their ids' hashes, which can be cut
into blocks, so that a node with very many children is spread out too.

Defined results
    blank ids (null, empty, only spaces)    not a node; a blank parent is no link
    a parent that is no node itself         ignored, the node is a root
    several records of one node             one node; the least non-blank parent
                                            that is recorded anywhere wins
    ids in different spelling               compared trimmed and in lower case
    a node that is its own parent           a cycle of length one
    empty input                             an empty table with the same columns
    extra columns, whatever their names     ignored
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagemill.operators.skew import lookup_join
from usagemill.session import cut, cut_counted

MAX_COMPONENT = 100_000
SCHEMA = "node_id string, parent_id string, kind string, root_id string, depth bigint, node_path string, descendants bigint, enter bigint, closes_cycle boolean"
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
_ARROW = pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in SCHEMA.split(", "))])
SIBLINGS_PER_BLOCK = 50_000
_FLUSH = 16_384
_FLUSH_CHARS = 8_000_000


def clean_id(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(c.cast("string"))), F.lit(""))


def link_table(df: DataFrame, node: Column, parent: Column) -> DataFrame:
    """(node, parent): one row per node; parent is null for a root."""
    named = df.select(clean_id(node).alias("node"), clean_id(parent).alias("parent")).filter(F.col("node").isNotNull())
    nodes, n = cut_counted(named.groupBy("node").agg(F.min("parent").alias("parent")), "nodes", n=F.count(F.lit(1)))
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    linked = lookup_join(nodes, known, "parent", total=n["n"])
    return cut(linked.select("node", F.when(F.col("known"), F.col("parent")).alias("parent")), "links")


def tree_roots(links: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Pointer doubling: (node, root) of all nodes below a root, the other nodes, and how many those are.

    Every step doubles the distance of each pointer, and nodes that have met
    their root leave the work. When a step settles no node, only nodes are left
    whose ancestors never end.
    """
    settled = [links.filter(F.col("parent").isNull()).select("node", F.col("node").alias("root"))]
    active = links.filter(F.col("parent").isNotNull()).select("node", F.col("parent").alias("ptr"))
    left = active.count()
    while left:
        known = active.select(F.col("node").alias("ptr"), F.col("ptr").alias("next"), F.lit(None).cast("string").alias("root"))
        for part in settled:
            known = known.unionByName(part.select(F.col("node").alias("ptr"), F.col("root").alias("next"), "root"))
        stepped, open_ = cut_counted(lookup_join(active, known, "ptr", total=left).select("node", F.col("next").alias("ptr"), "root"), "roots", n=F.count_if(F.col("root").isNull()))
        settled.append(stepped.filter(F.col("root").isNotNull()).select("node", "root"))
        active = stepped.filter(F.col("root").isNull()).select("node", "ptr")
        before, left = left, open_["n"]
        if before == left:
            break
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out, active.select("node"), left


def cycle_components(links: DataFrame, endless: DataFrame) -> DataFrame:
    """(node, component, on_cycle) of nodes whose ancestors never end.

    After enough doublings the pointers' targets are exactly the nodes on
    cycles (their number stops falling), and the least id met on the way around
    names the cycle. A node's component is that of its pointer's target.
    """
    state = cut(links.join(endless, "node", "left_semi").select("node", F.col("parent").alias("ptr"), F.col("node").alias("low")), "cycles")
    targets = state.select("ptr").distinct().count()
    while True:
        ahead = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("next"), F.col("low").alias("low2"))
        moved = lookup_join(state, ahead, "ptr")
        low = F.least("low", "low2")
        state = cut(moved.select("node", F.col("next").alias("ptr"), low.alias("low"), (low < F.col("low")).alias("changed")), "cycles")
        now = state.agg(F.count_distinct("ptr"), F.count_if("changed")).first()
        if now[0] == targets and now[1] == 0:
            break
        targets = now[0]
        state = state.drop("changed")
    ring = state.select("ptr").distinct().select(F.col("ptr").alias("node"), F.lit(True).alias("ring"))
    names = state.select(F.col("node").alias("ptr"), F.col("low").alias("component"))
    named = lookup_join(state.select("node", "ptr"), names, "ptr")
    return named.join(ring, "node", "left").select("node", "component", F.coalesce("ring", F.lit(False)).alias("on_cycle"))


def _walk(nodes: list[str], parents: list[str | None], label: str) -> Iterator[tuple]:
    """Depth-first through one component from its root or, in a loop, from label.

    White nodes are unseen, grey ones are on the current way down, black ones
    are done; a link to a grey node is a back edge and closes a cycle.
    """
    index = {n: i for i, n in enumerate(nodes)}
    children: list[list[int]] = [[] for _ in nodes]
    up = [-1] * len(nodes)
    start = index[label]
    for i, p in enumerate(parents):
        if p is not None:
            up[i] = index[p]
            children[up[i]].append(i)
    is_tree = up[start] < 0
    white, grey, black = 0, 1, 2
    colour = [white] * len(nodes)
    depth, size, enter = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    path: list[str] = [""] * len(nodes)
    on_cycle = [False] * len(nodes)
    closing = [False] * len(nodes)
    clock = 0
    path[start] = nodes[start]
    colour[start] = grey
    enter[start] = clock
    stack = [(start, iter(children[start]))]
    while stack:
        v, rest = stack[-1]
        child = next(rest, -1)
        if child < 0:
            colour[v] = black
            stack.pop()
            if stack:
                size[stack[-1][0]] += size[v] + 1
            if is_tree:
                yield nodes[v], parents[v], "tree", nodes[start], depth[v], path[v], size[v], enter[v], False
                path[v] = ""
        elif colour[child] == white:
            clock += 1
            colour[child] = grey
            enter[child] = clock
            depth[child] = depth[v] + 1
            if is_tree:
                path[child] = path[v] + "/" + nodes[child]
            stack.append((child, iter(children[child])))
        elif colour[child] == grey:
            closing[child] = True
            w = v
            while w != child:
                on_cycle[w] = True
                w = up[w]
            on_cycle[child] = True
    if not is_tree:
        for v, n in enumerate(nodes):
            yield n, parents[v], "cycle" if on_cycle[v] else "below_cycle", "", -1, "", -1, enter[v], closing[v]


def _walk_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (component, node, parent, ...), each component's rows together, siblings in the order of their hashes."""
    schema = _ARROW
    out: list[tuple] = []
    chars = 0

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    label, nodes, parents = None, [], []
    for batch in batches:
        for c, n, p in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if c != label:
                if nodes:
                    for row in _walk(nodes, parents, label):
                        out.append(row)
                        chars += len(row[5])
                        if len(out) >= _FLUSH or chars > _FLUSH_CHARS:
                            yield flush()
                            out.clear()
                            chars = 0
                label, nodes, parents = c, [], []
            nodes.append(n)
            parents.append(p)
    if nodes:
        for row in _walk(nodes, parents, label):
            out.append(row)
            chars += len(row[5])
            if len(out) >= _FLUSH or chars > _FLUSH_CHARS:
                yield flush()
                out.clear()
                chars = 0
    if out:
        yield flush()


def _subtree_sizes(links: DataFrame) -> DataFrame:
    """(node, up, below) of (node, up): below counts the nodes of the subtree, itself included.

    After k steps anc is the ancestor exactly 2^k links up (null above the
    root), and below counts the nodes of the subtree within distance 2^k.
    """
    there = F.count_if(F.col("anc").isNotNull())
    state, open_ = cut_counted(links.select("node", "up", F.col("up").alias("anc"), F.lit(1).cast("bigint").alias("below")), "sizes", n=there)
    while open_["n"]:
        ahead = state.select(F.col("node").alias("anc"), F.col("anc").alias("anc2"))
        gained = state.filter(F.col("anc").isNotNull()).groupBy(F.col("anc").alias("node")).agg(F.sum("below").alias("more"))
        stepped = lookup_join(state, ahead, "anc").select("node", "up", F.col("anc2").alias("anc"), "below").join(gained, "node", "left")
        state, open_ = cut_counted(stepped.select("node", "up", "anc", (F.col("below") + F.coalesce("more", F.lit(0))).alias("below")), "sizes", n=there)
    return state.select("node", "up", "below")


def _steps_in(sized: DataFrame, siblings_per_block: int = SIBLINGS_PER_BLOCK) -> DataFrame:
    """sized with step: by how much a node's depth-first number exceeds its parent's.

    That is 1 and the subtrees of the siblings before it, in the order of the
    ids' hashes. Siblings are summed up inside blocks of hashes, and the blocks'
    sums per parent in order.
    """
    bits = max(0, (sized.count() // siblings_per_block).bit_length())
    rows = sized.withColumn("h", F.xxhash64("node")).withColumn("block", F.shiftright("h", 64 - bits) if bits else F.lit(0).cast("bigint"))
    kids, roots = rows.filter(F.col("up").isNotNull()), rows.filter(F.col("up").isNull())
    within = Window.partitionBy("up", "block").orderBy("h", "node").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("up").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = kids.groupBy("up", "block").agg(F.sum("below").alias("all")).select("up", "block", F.coalesce(F.sum("all").over(across), F.lit(0)).alias("base"))
    kids = kids.withColumn("ahead", F.coalesce(F.sum("below").over(within), F.lit(0))).join(bases, ["up", "block"])
    return kids.select("node", "up", "below", (F.col("base") + F.col("ahead") + 1).alias("step")).unionByName(roots.select("node", "up", "below", F.lit(0).cast("bigint").alias("step")))


def _double(rows: DataFrame) -> DataFrame:
    """The columns of the walk for (component, node, parent, on_cycle), by doubling instead.

    A loop is cut at the node that names its component, and is then a tree like
    the others. After k steps anc is the ancestor exactly 2^k links up, and
    path, hops and enter cover the nearest 2^k nodes.
    """
    looped, first = F.col("on_cycle").isNotNull(), F.col("node") == F.col("component")
    up = F.when(looped & first, F.lit(None).cast("string")).otherwise(F.col("parent"))
    named = rows.select("component", "node", "parent", "on_cycle", up.alias("up"))
    steps = _steps_in(_subtree_sizes(named.select("node", "up")))
    there = F.count_if(F.col("anc").isNotNull())
    start = named.drop("up").join(steps, "node").select("component", "node", "parent", "on_cycle", "below", F.col("up").alias("anc"), F.when(~looped, F.col("node")).alias("path"), F.lit(0).cast("bigint").alias("hops"), F.col("step").alias("enter"))
    state, open_ = cut_counted(start, "paths", n=there)
    while open_["n"]:
        ahead = state.select(F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("path").alias("path2"), F.col("hops").alias("hops2"), F.col("enter").alias("enter2"))
        moved, top = lookup_join(state, ahead, "anc"), F.col("anc").isNull()
        state, open_ = cut_counted(
            moved.select(
                "component", "node", "parent", "on_cycle", "below", F.col("anc2").alias("anc"), F.when(top | F.col("path").isNull(), F.col("path")).otherwise(F.concat_ws("/", "path2", "path")).alias("path"),
                F.when(top, F.col("hops")).otherwise(F.col("hops") + F.col("hops2") + 1).alias("hops"), F.when(top, F.col("enter")).otherwise(F.col("enter") + F.col("enter2")).alias("enter"),
            ), "paths", n=there,
        )
    tree = ~looped
    return state.select(
        F.col("node").alias("node_id"), F.col("parent").alias("parent_id"), F.when(tree, "tree").when(F.col("on_cycle"), "cycle").otherwise("below_cycle").alias("kind"), F.when(tree, F.col("component")).otherwise("").alias("root_id"),
        F.when(tree, F.col("hops")).otherwise(-1).cast("bigint").alias("depth"), F.when(tree, F.col("path")).otherwise("").alias("node_path"), F.when(tree, F.col("below") - 1).otherwise(-1).cast("bigint").alias("descendants"),
        "enter", (looped & first).alias("closes_cycle"),
    )


def hierarchy(df: DataFrame, node: Column, parent: Column, max_component: int = MAX_COMPONENT) -> DataFrame:
    """One row per node: its place in its tree, or that it is caught in a loop.

    node_path holds all ancestors, descendants their number below; enter is the
    depth-first number within the component, so that a node's descendants are
    the rows with enter in (enter, enter + descendants]. closes_cycle marks back
    edges: the link from parent_id to node_id leads back to a node above. All
    columns are the same whatever max_component is.
    """
    links = link_table(df, node, parent)
    rooted, endless, n_endless = tree_roots(links)
    member = rooted.select("node", F.col("root").alias("component"), F.lit(None).cast("boolean").alias("on_cycle"))
    if n_endless:
        member = member.unionByName(cycle_components(links, endless))
    rows, n = cut_counted(member.join(links, "node"), "members", n=F.count(F.lit(1)))
    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_component)
    giants, found = cut_counted(sizes.select("component", F.lit(True).alias("giant")), "giants", n=F.count(F.lit(1)))
    if not found["n"]:
        small, big = rows, None
    else:
        marked = lookup_join(rows, giants, "component", total=n["n"])
        small, big = marked.filter(F.col("giant").isNull()), marked.filter(F.col("giant"))
    hashed = small.select("component", "node", "parent", F.xxhash64("node").alias("h"))
    walked = hashed.repartition("component").sortWithinPartitions("component", "h", "node").mapInArrow(_walk_sorted, SCHEMA)
    return walked if big is None else walked.unionByName(_double(big))
