from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from usagemill.llm.mixing import _of_many, encoded, mix, numbered, permute, shard_draws, shares
from usagemill.session import cut


def test_permutations():
    for n in (1, 2, 3, 17, 64, 1000):
        a, b = permute(np.arange(n), n, 5), permute(np.arange(n), n, 6)
        assert sorted(a) == list(range(n))
        if n > 10:
            assert list(a) != list(b) and list(a) != list(range(n))


def test_shards_add_up_to_the_quota():
    quota = np.array([1000, 37, 0, 263])
    total = np.zeros(4, dtype=int)
    for s in range(13):
        before, here = shard_draws(quota, s, 13, 100, 1)
        assert (before == total).all() and here.sum() == 100
        total += here
    assert (total == quota).all()


def test_huge_quotas_split_exactly():
    quota = np.array([6 * 10**9, 3 * 10**9 + 1, 999])
    shards = -(-int(quota.sum()) // 1000)
    before, here = shard_draws(quota, shards - 1, shards, 1000, 1)
    assert (before + here == quota).all()


def test_huge_quotas_are_drawn_at_random():
    quota = np.array([6 * 10**8, 3 * 10**8, 10**8 + 24])
    shards = -(-int(quota.sum()) // 1000)
    first = [shard_draws(quota, shards // 2, shards, 1000, seed)[0] for seed in range(40)]
    assert len({tuple(x) for x in first}) == 40
    each = np.array(first) - quota / 2
    spread = np.sqrt(quota.sum() / 4 * (quota / quota.sum()) * (1 - quota / quota.sum()))
    assert (np.abs(each.mean(axis=0)) < spread).all() and (each.std(axis=0) > spread / 2).all() and (each.std(axis=0) < spread * 2).all()


def test_draws_of_many_stay_possible():
    rng = np.random.default_rng(1)
    for good, whole, wanted in ((2 * 10**9 - 3, 2 * 10**9, 10**9), (5, 2 * 10**9, 2 * 10**9 - 2), (10**9, 2 * 10**9, 2 * 10**9), (0, 2 * 10**9, 7)):
        n = _of_many(good, whole, wanted, rng)
        assert max(0, wanted - (whole - good)) <= n <= min(good, wanted)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string, block string")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def run(spark, rows, want, **kw):
    drawn, made = mix(frame(spark, rows), F.col("doc_id"), F.col("source"), F.col("text"), targets(spark, want), **kw)
    return drawn.collect(), {r.source: r for r in shares(drawn, made).collect()}


ROWS = [(i, "big", "some words of text here " * (1 + i % 7), "z") for i in range(200)] + [(1000 + i, "small", "tiny words " * 9, "z") for i in range(8)] + [(2000, "other", "not wanted", "z"), (3000, None, "no source", "z"), (4000, "big", "", "z"), (4001, "big", None, "z"), (5, "big", "some words of text here ", "z")]
WANT = [("big", 0.7, 1), ("small", 0.25, 4), ("absent", 0.05, 3), (None, 0.1, 1)]


def test_shares_and_repeats(spark, tok):
    rows, got = run(spark, ROWS, WANT, block=16, slots=8)
    assert abs(got["big"].reached_share - 0.7 / 0.95) < 0.02 and abs(got["small"].reached_share - 0.25 / 0.95) < 0.02
    assert got["absent"].drawn_tokens == 0 and got["absent"].reached_share == 0 and got[None].drawn_tokens == 0
    assert got["small"].passes <= 4 and got["big"].passes == 1
    used, text_of = defaultdict(Counter), {i: t for i, _, t, _ in reversed(ROWS)}
    for r in rows:
        assert len(r.tokens) == r.n_tokens == sum(p.n_tokens for p in r.parts) <= 16
        at = 0
        for p in r.parts:
            ids = tok.core.encode_ordinary(text_of[p.doc_id])[p.first_token : p.first_token + p.n_tokens]
            assert p.doc_id == 5 or r.tokens[at : at + p.n_tokens] == ids
            at += p.n_tokens
            for t in range(p.first_token, p.first_token + p.n_tokens):
                used[p.doc_id][t] += 1
    assert all(max(c.values()) <= 4 for d, c in used.items() if 1000 <= d < 2000)
    assert all(max(c.values()) <= (2 if d == 5 else 1) for d, c in used.items() if d < 1000)
    assert not {2000, 3000, 4000, 4001} & set(used)
    slots = Counter((r.shard, r.slot) for r in rows)
    assert {s for s, _ in slots} == set(range(max(s for s, _ in slots) + 1))
    assert len(slots) == len(rows)


def test_a_given_size_is_met(spark, tok):
    rows, _ = run(spark, ROWS, WANT, block=8, slots=8, total_tokens=400)
    assert abs(sum(r.n_tokens for r in rows) - 400) <= 16


def test_draws_are_repeatable(spark, tok):
    assert sorted(run(spark, ROWS, WANT, block=16)[0]) == sorted(run(spark, ROWS, WANT, block=16)[0])


def test_empty(spark, tok):
    rows, got = run(spark, [], WANT)
    assert rows == [] and got["big"].reached_share == 0
    assert run(spark, ROWS, [])[0] == []


def test_more_targets_than_before(spark, tok):
    rows = [(i, f"s{i}", "some words of text here " * 3, "z") for i in range(60)]
    drawn, got = run(spark, rows, [(f"s{i}", 1 / 60, 1) for i in range(60)] + [(f"gone{i}", 0.0, 1) for i in range(12_000)], block=4)
    assert {r.source for r in drawn} == {f"s{i}" for i in range(60)} and len(got) == 12_060


def test_blocks_tile_each_source(spark, tok):
    rows = [(i, "a" if i % 3 else "b", "word " * (i % 50)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(4)
    made = cut(encoded(df, F.col("doc_id"), F.col("source"), F.col("text"), 64), "blocks")
    got = numbered(made, 64).collect()
    for source in "ab":
        mine = sorted((r for r in got if r.source == source), key=lambda r: r.block)
        assert [r.block for r in mine] == list(range(len(mine))) and {r.n_tokens for r in mine[:-1]} == {64}
        seen = defaultdict(list)
        for r in mine:
            assert len(r.tokens) == r.n_tokens == sum(p.n_tokens for p in r.parts)
            for p in r.parts:
                seen[p.doc_id] += range(p.first_token, p.first_token + p.n_tokens)
        assert {d: sorted(t) for d, t in seen.items()} == {i: list(range(tok.count(t))) for i, s, t in rows if s == source and t}
