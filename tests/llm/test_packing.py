import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from usagemill.llm.packing import loss_mask, pack, pack_texts, pieces


def test_pack_keeps_limits_and_every_example():
    rng = np.random.default_rng(1)
    sizes = np.column_stack([rng.integers(0, 101, 500), np.ones(500, dtype=int), rng.integers(0, 60, 500)])
    limits = np.array([100, 7, 80])
    bins = pack(sizes, limits)
    assert sorted(i for b in bins for i in b) == list(range(500))
    assert all((sizes[b].sum(axis=0) <= limits).all() for b in bins)


def plain_pack(sizes, limits):
    """The heuristic by a search of all classes."""
    kinds, member = np.unique(sizes, axis=0, return_inverse=True)
    member, scaled = member.reshape(-1), kinds / limits
    left, bins = np.bincount(member, minlength=len(kinds)), []
    while left.sum():
        weight, room, held = (scaled * left[:, None]).sum(axis=0) / left.sum(), np.ones(len(limits)), []
        while True:
            ok = (left > 0) & ((scaled <= np.maximum(room, 0) + 1e-12).all(axis=1) | (not held))
            if not ok.any():
                break
            score = np.where(ok, scaled @ (weight * np.maximum(room, 0)), -1)
            best = np.flatnonzero(score >= score.max() - 1e-12)[0]
            held.append(tuple(kinds[best]))
            left[best] -= 1
            room = room - scaled[best]
        bins.append(held)
    return bins


def test_the_bounded_search_finds_what_a_search_of_all_finds():
    rng = np.random.default_rng(4)
    for limits, top in ((np.array([1000, 64, 800]), 900), (np.array([100, 5, 60]), 100)):
        n = rng.integers(1, top, 1500)
        sizes = np.column_stack([n, np.ones_like(n), (n * rng.choice([0.0, 0.3, 1.0], 1500)).astype(int)])
        bins, plain = pack(sizes, limits), plain_pack(sizes, limits)
        assert abs(len(bins) - len(plain)) <= max(2, len(plain) // 200)
        assert [tuple(sizes[i]) for i in bins[0]] == [tuple(x) for x in plain[0]]


def test_an_example_above_a_limit_takes_only_what_weighs_nothing_there():
    sizes, limits = np.array([[90, 1, 90], [5, 1, 0], [5, 1, 5], [60, 1, 60]]), np.array([100, 7, 80])
    bins = pack(sizes, limits)
    first = next(b for b in bins if 0 in b)
    assert set(first) == {0, 1} and sorted(i for b in bins for i in b) == [0, 1, 2, 3]


def test_pack_is_near_the_lower_bound():
    rng = np.random.default_rng(2)
    n = rng.integers(1, 500, 3000)
    bins = pack(np.column_stack([n, np.ones_like(n), n]), np.array([1000, 64, 1000]))
    assert len(bins) <= 1.01 * n.sum() / 1000 + 1


def test_dialogue_loss_counts_assistant_turns_only(tok):
    text = "[user] one two\n\n[assistant] three four five\n[tool]\nx\n[assistant] six"
    ids = tok.core.encode_ordinary(text)
    mask = loss_mask(text, tok.ends(text))
    said = tok.core.decode([i for i, m in zip(ids, mask) if m])
    assert "three four five" in said and "six" in said and "two" not in said and "x\n" not in said
    assert loss_mask("plain [assistant] text", tok.ends("plain [assistant] text")).all()
    assert loss_mask("[note] text", tok.ends("[note] text")).all()


def test_pieces_cut_only_what_is_larger(tok):
    text = "word " * 500
    n = tok.count(text)
    assert pieces(text, n, tok_path()) == [(0, n, n)]
    parts = pieces(text, 100, tok_path())
    assert sum(p[1] for p in parts) == n and all(p[1] == 100 for p in parts[:-1])
    assert pieces("", 10, tok_path()) == pieces(None, 10, tok_path()) == [(0, 0, 0)]


def tok_path():
    from usagemill.llm.tokens import DEFAULT_VOCABULARY

    return DEFAULT_VOCABULARY


def run(spark, rows, capacity=64, segments=5, loss=None):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, container_id string")
    return pack_texts(df, F.col("doc_id"), F.col("text"), capacity, segments, loss).collect()


def test_containers_hold_everything_once(spark, tok):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "naïve", "日本", "x1"]) for _ in range(rng.randrange(60))), "c") for i in range(300)]
    rows += [(None, "lost id", "c"), (7, rows[7][1], "c"), (900, None, "c"), (901, "", "c"), (902, "long " * 3000, "c")]
    got = run(spark, rows, loss=50)
    per = defaultdict(list)
    for r in got:
        per[r.container_id].append(r)
    for held in per.values():
        assert sum(r.n_tokens for r in held) <= 64 and len(held) <= 5
        assert sum(r.n_loss for r in held) <= 50 or sum(r.n_loss > 0 for r in held) == 1
        assert sorted(r.position for r in held) == list(range(len(held)))
    assert sum(r.n_tokens for r in got) == sum(tok.count(r[1]) for r in rows)
    assert sum(r.piece == 0 for r in got) == len(rows)
    whole = {r.doc_id: r for r in got if r.piece == 0}
    assert whole[900].n_tokens == whole[901].n_tokens == 0
    assert sum(r.doc_id == 902 for r in got) == -(-tok.count("long " * 3000) // 64)


def test_empty_and_bad_limits(spark, tok):
    assert run(spark, []) == []
    with pytest.raises(ValueError):
        run(spark, [(1, "a", "c")], capacity=0)


def test_fill_on_the_tables(spark, data, tok):
    from usagemill.llm.queries import p7_fill, p7_packed

    fill = p7_fill(spark, data).first()
    assert fill.fullest <= 2048 and fill.fill > 0.9
    docs = spark.read.parquet(f"{data}/documents.parquet").count()
    assert p7_packed(spark, data).filter("piece = 0").count() == docs
