import numpy as np
import pytest
from pyspark.sql import functions as F

from usagemill.llm.splitting import Text, boundaries, landmarks, split_texts


def run(spark, rows, max_tokens=100, overlap=10, **kw):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, piece string")
    return split_texts(df, F.col("doc_id"), F.col("text"), max_tokens, overlap, **kw).orderBy("doc_id", "piece").collect()


def prose(n, seed=0):
    rng = np.random.default_rng(seed)
    words = ["ledger", "counts", "replayed", "history", "Äpfel", "when", "cold", "cache", "日次"]
    out = []
    for i in range(n):
        out.append(" ".join(rng.choice(words, rng.integers(3, 12))) + ". ")
        if rng.random() < 0.2:
            out.append("\n\n")
    return "".join(out)


def check(tok, text, rows, max_tokens, overlap):
    ids = tok.core.encode_ordinary(text)
    assert len(ids) > max_tokens and rows[0].first_token == 0
    for k, r in enumerate(rows):
        assert r.piece == k and r.n_tokens <= max_tokens and tok.count(r.piece_text) <= max_tokens
        assert tok.core.decode_bytes(ids[r.first_token : r.first_token + r.n_tokens]).decode() == r.piece_text
    for a, b in zip(rows, rows[1:]):
        shared = a.first_token + a.n_tokens - b.first_token
        assert b.overlap == shared and overlap <= shared <= overlap + 3
    assert rows[-1].first_token + rows[-1].n_tokens == len(ids)


def test_pieces_fit_share_and_cover(spark, tok):
    for seed, text in enumerate([prose(80), prose(200, 3), "日本語の文章です。" * 90, "🙂" * 300, "x" * 5000, "one two\n" * 300, "a b " * 700, "few words\n\n" + "y7" * 4000, "w " * 9 + "q" * 3000 + " and more" * 200]):
        for overlap in (0, 10, 40):
            check(tok, text, run(spark, [(seed, text, "c")], 100, overlap), 100, overlap)


def test_ends_are_natural_where_there_are_any(spark, tok):
    rows = run(spark, [(1, prose(300), "c")])
    assert {r.ends_at for r in rows} <= {"paragraph", "line", "sentence"}
    assert {r.ends_at for r in run(spark, [(1, "word " * 900, "c")])[:-1]} == {"space"}
    assert "none" in {r.ends_at for r in run(spark, [(1, "q" * 9000, "c")])}


def test_an_edit_alters_only_pieces_near_it(spark, tok):
    text = prose(900, 5)
    cut = len(text) // 2
    edited = text[:cut] + " inserted words here " + text[cut:]
    a = [r.piece_text for r in run(spark, [(1, text, "c")], 200, 0, min_tokens=40)]
    b = [r.piece_text for r in run(spark, [(1, edited, "c")], 200, 0, min_tokens=40)]
    assert len(set(a) - set(b)) <= 4 and len(a) > 40


def test_small_null_empty_and_repeated(spark, tok):
    long = prose(60)
    rows = run(spark, [(1, "short", "c"), (2, None, "c"), (3, "", "c"), (None, long, "c"), (4, long, "c"), (4, long, "c")])
    assert {r.doc_id for r in rows} == {None, 4}
    assert sum(r.piece == 0 for r in rows) == 3
    assert run(spark, []) == []
    with pytest.raises(ValueError):
        run(spark, [(1, "a", "c")], 10, 10)


def test_exactly_the_limit_is_not_oversized(spark, tok):
    text = "word" + " word" * 99
    assert tok.count(text) == 100 and run(spark, [(1, text, "c")]) == []
    assert len(run(spark, [(1, text + " word", "c")])) == 2


def test_landmarks_depend_on_the_text_near_them():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50000, 5000)
    a = landmarks(ids, 64)
    b = landmarks(np.concatenate([[1, 2, 3], ids]), 64)
    assert len(a) > 30 and set(a + 3) <= set(b)


def test_levels(tok):
    text = "One. Two\nthree\n\nfour 3.5。x"
    x = Text(tok, text)
    level = boundaries(x)
    named = {text.encode()[:a].decode("utf-8", "ignore"): v for a, v in zip(x.at, level)}
    assert named["One."] == 2 and named["One. Two\n"] == 3 and named["One. Two\nthree\n\n"] == 4
    assert named["One. Two\nthree\n\nfour"] == 1 and named["One. Two\nthree\n\nfour 3"] == 0 and named["One. Two\nthree\n\nfour 3.5。"] == 2


def test_a_piece_alone_is_counted_from_its_edges(tok):
    rng = np.random.default_rng(4)
    parts = ["word", " ", "  ", "\n", "\n\n", "don't", "日本", "\u3000", "\u00a0", "a.b", "12 34", "🙂", "'s", "\t", "e\u0301", "x" * 40]
    for _ in range(60):
        x = Text(tok, "".join(rng.choice(parts, 60)))
        for _ in range(20):
            a, b = sorted(rng.integers(0, len(x.at), 2))
            if a < b and (a == 0 or x.data[x.at[a]] & 0xC0 != 0x80) and (x.at[b] == len(x.data) or x.data[x.at[b]] & 0xC0 != 0x80):
                assert x.alone(a, b) == tok.count(x.piece(a, b))


def test_found_against_brute_force(spark, data, tok):
    from usagemill.llm.queries import p9_found

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert {r.doc_id for r in p9_found(spark, data).collect()} == {r.doc_id for r in docs if tok.count(r.text) > 4096}
