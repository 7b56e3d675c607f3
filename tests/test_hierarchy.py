import random

from pyspark.sql import functions as F

from usagemill.operators.hierarchy import hierarchy


def brute(rows):
    parent = {}
    for i, p in rows:
        i, p = (i or "").strip(" ").lower(), (p or "").strip(" ").lower()
        if i:
            parent[i] = min(x for x in (parent.get(i), p or None) if x) if (parent.get(i) or p) else None
    parent = {i: p if p in parent else None for i, p in parent.items()}
    out, below = {}, dict.fromkeys(parent, 0)
    for i in parent:
        chain, at = [i], parent[i]
        while at is not None and at not in chain:
            chain.append(at)
            at = parent[at]
        if at is None:
            for a in chain[1:]:
                below[a] += 1
            out[i] = ["tree", chain[-1], len(chain) - 1, "/".join(reversed(chain))]
        else:
            out[i] = ["cycle" if at == i else "below_cycle", "", -1, ""]
    return {i: (*v, below[i] if v[0] == "tree" else -1) for i, v in out.items()}


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id string, up string, node_id int, parent string") if rows and len(rows[0]) == 4 else spark.createDataFrame(rows, "id string, up string")
    return hierarchy(df, F.col("id"), F.col("up"), **kw)


def as_map(df):
    rows = df.collect()
    assert len({r.node_id for r in rows}) == len(rows)
    return {r.node_id: (r.kind, r.root_id, r.depth, r.node_path, r.descendants) for r in rows}


ODD = [("A ", None), ("a", "b"), ("b", ""), ("b", " "), ("c", "A"), (None, "a"), ("  ", "a"), ("d", "gone"), ("x", "y"), ("y", "x"), ("z", "x"), ("zz", "z"), ("s", "s"), ("c", None), ("c", "a")]


def test_kinds_paths_and_spelling(spark):
    assert as_map(run(spark, ODD)) == brute(ODD)


def test_random_forests(spark):
    rng = random.Random(3)
    rows = [(f"n{i}", f"n{rng.randrange(0, 160)}" if rng.random() < 0.9 else None) for i in range(150)]
    rows += [(f"chain{i}", f"chain{i - 1}" if i else None) for i in range(30)] + [(f"star{i}", "chain3") for i in range(60)]
    want = brute(rows)
    assert as_map(run(spark, rows)) == want
    assert as_map(run(spark, rows, max_component=20)) == want


def test_all_columns_are_the_same_for_giants(spark):
    rng = random.Random(8)
    rows = ODD + [(f"n{i}", f"n{rng.randrange(0, i)}" if i % 9 else None) for i in range(60)] + [(f"star{i}", "n7") for i in range(60)] + [(f"ring{i}", f"ring{(i + 1) % 5}") for i in range(5)] + [(f"tail{i}", f"ring{i % 5}") for i in range(20)]
    want = sorted(run(spark, rows).collect(), key=lambda r: r.node_id)
    assert all(r.enter is not None for r in want)
    assert sorted(run(spark, rows, max_component=1).collect(), key=lambda r: r.node_id) == want


def test_siblings_in_blocks_sum_up_like_one_row(spark):
    from usagemill.operators.hierarchy import _steps_in

    rows = [("root", None, 301)] + [(f"k{i}", "root", 1 + i % 3) for i in range(150)]
    df = spark.createDataFrame(rows, "node string, up string, below bigint")
    assert sorted(_steps_in(df, 8).collect()) == sorted(_steps_in(df).collect())


def test_enter_numbers_span_the_descendants(spark):
    rows = [(f"n{i}", f"n{(i - 1) // 2}" if i else None) for i in range(40)]
    got = run(spark, rows).collect()
    for a in got:
        inside = {b.node_id for b in got if a.enter < b.enter <= a.enter + a.descendants}
        assert inside == {b.node_id for b in got if b.node_path.startswith(a.node_path + "/")}


def test_back_edges(spark):
    for limit in (100, 1):
        closing = {(r.node_id, r.parent_id) for r in run(spark, ODD, max_component=limit).filter("closes_cycle").collect()}
        assert closing == {("x", "y"), ("s", "s")}


def test_empty_and_clashing_columns(spark):
    empty = run(spark, [])
    assert empty.count() == 0 and empty.columns[0] == "node_id"
    rows = [("a", None, 1, "q"), ("b", "a", None, None)]
    assert as_map(run(spark, rows))["b"] == ("tree", "a", 1, "a/b", 0)


def test_very_long_ids(spark):
    big = "k" * 100_000
    assert as_map(run(spark, [(big, None), ("x", big)]))["x"][3] == big + "/x"
