"""Splitting oversized texts at natural boundaries (content-defined chunking).

A rolling hash over the token ids marks landmarks that depend on the text near
them only. From the start of a piece, the first landmark beyond the minimum
size is taken and moved to the nearest natural boundary within the minimum and
maximum sizes: the end of a paragraph, line or sentence, else a space, else
the landmark itself. An edit moves the landmarks around it, and the pieces
further away come out as before. Consecutive pieces share overlap tokens.

Sizes count tokens of the whole text; a piece must also fit when its own text
is encoded, so its edges are encoded again and its end moved back if need be. Cuts never fall inside a
character. It is a pass over the texts without any shuffle.

Defined results
    a text of at most max_tokens    no piece; it isn't oversized
    null or empty text              no piece
    equal rows, null ids            each row is split for itself
    no boundary from the minimum to the maximum size
                                    the last one below the minimum; without any,
                                    the piece ends at its landmark
    empty input                     an empty table
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from usagemill.llm.tokens import DEFAULT_VOCABULARY, ByteTokenizer, tokenizer

PIECES = "doc_id bigint, piece int, first_token bigint, n_tokens bigint, overlap bigint, overlap_bytes bigint, ends_at string, piece_text string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("overlap", pa.int64()), ("overlap_bytes", pa.int64()), ("ends_at", pa.string()), ("piece_text", pa.string())])
WINDOW = 16
SPACING = 256
LEVELS = ("none", "space", "sentence", "line", "paragraph")
_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)


def landmarks(ids: np.ndarray, spacing: int = SPACING) -> np.ndarray:
    """Token positions (a cut before that token) whose preceding window of ids hashes to zero modulo spacing."""
    if len(ids) < WINDOW:
        return np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        mixed = ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x2545F4914F6CDD1D)
        mixed ^= mixed >> np.uint64(32)
        rolled = np.zeros(len(ids) - WINDOW + 1, dtype=np.uint64)
        for k in range(WINDOW):
            rolled += mixed[k : k + len(rolled)] * _MULTIPLIERS[WINDOW - 1 - k]
        rolled ^= rolled >> np.uint64(29)
        rolled *= np.uint64(0xBF58476D1CE4E5B9)
    return np.flatnonzero((rolled >> np.uint64(33)) % np.uint64(spacing) == 0) + WINDOW


class Text:
    """One text's bytes, tokens and white space, for cutting it at tokens."""

    def __init__(self, t: ByteTokenizer, text: str) -> None:
        self.t, self.raw, self.ids = t, text.encode(), t.ids(text)
        self.at = np.concatenate([[0], np.cumsum(t.width[self.ids])])
        data = np.frombuffer(self.raw, dtype=np.uint8)
        self.data, self.space = data, (data == 32) | ((data >= 9) & (data <= 13))
        #: Where white space follows anything else: no token reaches across, whatever stands before or after.
        self.joints = np.flatnonzero(self.space[1:] & ~self.space[:-1]) + 1

    def piece(self, a: int, b: int) -> str:
        return self.raw[self.at[a] : self.at[b]].decode("utf-8", "replace")

    def _joint(self, lo: int, hi: int, last: bool) -> int | None:
        """The first or last joint in lo..hi whose character before is no white space of another script."""
        i, j = np.searchsorted(self.joints, [lo + 1, hi])
        for k in range(j - 1, i - 1, -1) if last else range(i, j):
            q = int(self.joints[k])
            if not self.raw[max(0, q - 4) : q].decode("utf-8", "ignore")[-1:].isspace():
                return q
        return None

    def alone(self, a: int, b: int) -> int:
        """Tokens of the piece a..b encoded on its own.

        Only its head and tail can come out differently from the whole text:
        up to the first joint, and from the last one on.
        """
        lo, hi = int(self.at[a]), int(self.at[b])
        first, last = self._joint(lo, hi, False), self._joint(lo, hi, True)
        if first is None or last is None:
            return self.t.count(self.piece(a, b))
        middle = int(np.searchsorted(self.at, last) - np.searchsorted(self.at, first))
        return self.t.count(self.raw[lo:first].decode("utf-8", "replace")) + middle + self.t.count(self.raw[last:hi].decode("utf-8", "replace"))


def boundaries(x: Text) -> np.ndarray:
    """Level of a cut at each token position 0..n: 0 none up to 4 paragraph; -1 inside a character.

    A token often begins with the space before its word, so a cut anywhere in
    or beside a run of white space counts for that run: with two line breaks it
    ends a paragraph, with one a line, behind a full stop a sentence.
    """
    size = len(x.data)
    starts = np.flatnonzero(x.space & ~np.concatenate([[False], x.space[:-1]]))
    run = np.cumsum(np.concatenate([[0], (x.space & ~np.concatenate([[False], x.space[:-1]])).astype(np.int64)])[1:]) - 1
    breaks = np.bincount(run[x.data == 10], minlength=len(starts)) if len(starts) else np.zeros(0, dtype=np.int64)
    level = np.ones(len(starts), dtype=np.int8)
    stop = np.isin(x.data, np.frombuffer(b".!?", dtype=np.uint8))
    quote = np.isin(x.data, np.frombuffer(b"\"')]", dtype=np.uint8))
    one, two = np.maximum(starts - 1, 0), np.maximum(starts - 2, 0)
    level[(starts > 0) & (stop[one] | (quote[one] & stop[two]))] = 2
    level[breaks == 1] = 3
    level[breaks > 1] = 4
    out = np.zeros(len(x.at), dtype=np.int8)
    here, before = np.minimum(x.at, size - 1), np.maximum(x.at - 1, 0)
    at_space = (x.at < size) & x.space[here]
    after_space = (x.at > 0) & x.space[before]
    out[after_space] = level[run[before[after_space]]]
    out[at_space] = level[run[here[at_space]]]
    pad = np.concatenate([np.zeros(3, dtype=np.uint8), x.data])
    b3, b2, b1 = pad[x.at], pad[x.at + 1], pad[x.at + 2]
    wide = ((b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x82)) | ((b3 == 0xEF) & (b2 == 0xBC) & ((b1 == 0x81) | (b1 == 0x9F)))
    out[wide & (out < 2)] = 2
    out[(x.at < size) & ((x.data[here] & 0xC0) == 0x80)] = -1
    out[-1] = 4
    return out


def cut_points(x: Text, max_tokens: int, min_tokens: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, stop, level) in tokens of each piece."""
    n = len(x.ids)
    level, marks = boundaries(x), landmarks(x.ids)
    out, start, fresh = [], 0, 0
    while True:
        if n - start <= max_tokens and x.alone(start, n) <= max_tokens:
            out.append((start, n, 4))
            return out
        # A piece is longer than what it shares with the next, which so begins after it.
        least = max(fresh, start + overlap) + 1
        low, high = max(least, min(fresh + min_tokens, start + max_tokens - 1)), min(n - 1, start + max_tokens)
        while True:
            stop = _stop(level, marks, low, high, overlap, least)
            over = x.alone(start, stop) - max_tokens
            if over <= 0 or stop <= least:
                break
            high = max(least, stop - over)
            low = min(low, high)
        out.append((start, stop, int(max(0, level[stop]))))
        fresh, start = stop, max(0, stop - overlap)
        while start > 0 and level[start] < 0:
            start -= 1
        if start <= out[-1][0]:
            start = fresh


def _stop(level: np.ndarray, marks: np.ndarray, low: int, high: int, overlap: int, least: int) -> int:
    """The cut within low..high: the first landmark, moved to the nearest natural boundary.

    Where low..high has none, the last one from least on is taken, below the
    minimum size; only where there's none at all does the landmark itself stand.
    """
    i = np.searchsorted(marks, low)
    mark = int(marks[i]) if i < len(marks) and marks[i] <= high else high
    span = np.arange(low, high + 1)
    whole = level[low : high + 1] >= 0
    begin = span - overlap
    aligned = whole & ((begin < 0) | (level[np.maximum(begin, 0)] >= 0))
    for wanted in (2, 1, 0):
        if wanted == 0:
            early = np.flatnonzero(level[least:low] >= 1)
            if len(early):
                return int(least + early[-1])
        for usable in (aligned, whole):
            fit = span[usable & (level[low : high + 1] >= wanted)]
            if len(fit):
                return int(fit[np.argmin(np.abs(fit - mark))])
    return high


def _splitter(max_tokens: int, overlap: int, min_tokens: int, path: str, with_text: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                # A token spans at least one byte, so a text of at most max_tokens bytes can't be oversized.
                if not value.is_valid or len(value.as_buffer()) <= max_tokens:
                    continue
                x = Text(t, value.as_py())
                if len(x.ids) <= max_tokens:
                    continue
                stop_before = 0
                for k, (a, b, tier) in enumerate(cut_points(x, max_tokens, min_tokens, overlap)):
                    rows.append((doc_id, k, a, b - a, max(0, stop_before - a), max(0, int(x.at[stop_before] - x.at[a])), LEVELS[tier], x.piece(a, b) if with_text else None))
                    stop_before = b
            columns = list(zip(*rows)) if rows else [[] for _ in _SCHEMA]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)

    return run


def split_texts(df: DataFrame, doc_id: Column, text: Column, max_tokens: int, overlap: int, min_tokens: int | None = None, vocabulary: str = DEFAULT_VOCABULARY, with_text: bool = True) -> DataFrame:
    """The pieces of every text of more than max_tokens tokens.

    overlap is how many of a piece's tokens the piece before has too, and
    overlap_bytes how much of its text that is.
    """
    least = max(overlap + 1, max_tokens // 2) if min_tokens is None else min_tokens
    if not 0 <= overlap < max_tokens or not 0 < least <= max_tokens:
        raise ValueError("needs 0 <= overlap < max_tokens and 0 < min_tokens <= max_tokens")
    two = df.select(doc_id.cast("bigint").alias("doc_id"), text.alias("text"))
    return two.mapInArrow(_splitter(max_tokens, overlap, least, vocabulary, with_text), PIECES)
