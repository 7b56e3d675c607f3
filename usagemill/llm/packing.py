"""Filling fixed-capacity containers with texts (vector bin packing).

A text is an example with three sizes: tokens, segments (one per text or piece)
and loss-bearing tokens, those the model learns to produce: in a dialogue the
assistant's turns, in any other text all tokens. A container has a limit on
each. The dot-product heuristic fills one container at a time: of the examples
that still fit, it takes the one whose sizes, weighted by what the remaining
examples need, point most in the direction of the room that is left.

Packing is one pass without any shuffle. Each task streams its split of the
texts, keeps a pool of examples, and hands the examples of poorly filled
containers on to its next pool. Whatever the rows are (one huge source, equal
rows, null keys), no task holds more than a pool.

Defined results
    a text above the token limit      cut into pieces of exactly the limit and a
                                      rest, as tokens; no other text is cut
    a text above the loss limit only  not cut: it gets a container of its own, which
                                      takes besides only what bears no loss
    null or empty text                an example of no tokens; it takes a segment
    equal rows                        each is placed
    null ids                          placed like the rest
    empty input                       an empty table
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame

from usagemill.llm.tokens import DEFAULT_VOCABULARY, tokenizer

POOL = 4096
FULL = 0.97
CHUNK = 512
PLACED = "container_id bigint, position int, doc_id bigint, piece int, first_token bigint, n_tokens bigint, n_loss bigint"
_SCHEMA = pa.schema([("container_id", pa.int64()), ("position", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("n_loss", pa.int64())])
ROLES = (b"[user]", b"[assistant]", b"[tool]", b"[system]")


def loss_spans(raw: bytes) -> list[tuple[int, int]] | None:
    """Byte spans of the assistant's turns, or None if the text is no dialogue.

    A turn begins at a line that starts with a role in brackets.
    """
    marks = []
    at = 0
    while at < len(raw):
        for role in ROLES:
            if raw.startswith(role, at):
                marks.append((at, role))
                break
        at = raw.find(b"\n[", at) + 1
        if at == 0:
            break
    if not marks or marks[0][0]:
        return None
    ends = [m[0] for m in marks[1:]] + [len(raw)]
    return [(a, b) for (a, role), b in zip(marks, ends) if role == b"[assistant]"]


def loss_mask(text: str, ends: np.ndarray) -> np.ndarray:
    """For each token, whether it bears loss: its first byte lies in an assistant turn."""
    if not text.startswith("["):
        return np.ones(len(ends), dtype=bool)
    spans = loss_spans(text.encode("utf-8", "replace"))
    if spans is None:
        return np.ones(len(ends), dtype=bool)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    mask = np.zeros(len(ends), dtype=bool)
    for a, b in spans:
        mask[np.searchsorted(starts, a) : np.searchsorted(starts, b)] = True
    return mask


def pieces(text: str | None, limit: int, path: str) -> list[tuple[int, int, int]]:
    """(first_token, n_tokens, n_loss) of a text's pieces; one piece if it fits."""
    ends = tokenizer(path).ends(text)
    if not len(ends):
        return [(0, 0, 0)]
    below = np.concatenate([[0], np.cumsum(loss_mask(text, ends))])
    return [(at, stop - at, int(below[stop] - below[at])) for at in range(0, len(ends), limit) for stop in (min(len(ends), at + limit),)]


def pack(sizes: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Indexes of examples per container, by the dot-product heuristic.

    sizes has a row per example and a column per dimension. Examples of equal
    sizes are one class; a container is filled by taking, among the classes
    that fit, the one with the largest weighted dot product with the room left.
    An example above a limit fits an empty container only.

    Classes are kept in descending order of their largest possible product per
    unit of direction, their first dimension's upper bound: no product of a
    class exceeds top, its largest scaled size, times the sum of the
    directions. So the search runs through the classes in chunks, and ends when
    the next chunk's bound is below the best found: it gives the class that a
    search of all would give, without looking at all.
    """
    kinds, member = np.unique(sizes, axis=0, return_inverse=True)
    top = (kinds / limits).max(axis=1)
    rank = np.argsort(-top, kind="stable")
    place = np.empty(len(kinds), dtype=np.int64)
    place[rank] = np.arange(len(kinds))
    kinds, top, member = kinds[rank], top[rank], place[member.reshape(-1)]
    order = np.argsort(member, kind="stable")
    counts = np.bincount(member, minlength=len(kinds))
    heads = np.concatenate([[0], np.cumsum(counts)[:-1]])
    scaled = kinds / limits
    need = (scaled * counts[:, None]).sum(axis=0)
    bins: list[list[int]] = []
    left = len(sizes)
    live, stock, dead = np.arange(len(kinds)), counts.copy(), 0
    shapes, falling = scaled, -top
    while left:
        if dead * 4 > len(live):
            some = stock > 0
            live, stock, shapes, falling, dead = live[some], stock[some], shapes[some], falling[some], 0
        weight = np.maximum(need, 0) / left
        room = np.ones(len(limits))
        held: list[int] = []
        while True:
            space = np.maximum(room, 0)
            direction = weight * space
            reach, space = float(direction.sum()), space + 1e-12
            best, best_score = -1, -1.0
            # Classes whose largest size is above all room left can't fit, unless the container is empty.
            at = int(np.searchsorted(falling, -float(space.max()))) if held else 0
            while at < len(live) and (best < 0 or -falling[at] * reach > best_score):
                part = shapes[at : at + CHUNK]
                ok = stock[at : at + CHUNK] > 0
                if held:
                    ok &= (part <= space).all(axis=1)
                score = part @ direction
                score[~ok] = -1.0
                k = int(score.argmax())
                if score[k] > best_score:
                    best, best_score = at + k, float(score[k])
                at += CHUNK
            if best < 0:
                break
            c = live[best]
            held.append(int(order[heads[c] + counts[c] - stock[best]]))
            stock[best] -= 1
            dead += int(stock[best] == 0)
            need = need - shapes[best]
            room = room - shapes[best]
            left -= 1
        bins.append(held)
    return bins


def _pack_split(limits: tuple[int, int, int], path: str, most_held: int, full: float):  # noqa: ANN202
    most = np.array(limits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        serial = (task.partitionId() if task else 0) << 40
        pool: list[tuple[int | None, int, int, int, int]] = []

        def place(last: bool) -> tuple[pa.RecordBatch, list]:
            nonlocal serial
            sizes = np.array([(n, 1, loss) for _, _, _, n, loss in pool], dtype=np.int64).reshape(-1, 3)
            rows, rest = [], []
            for held in pack(sizes, most):
                total = sizes[held].sum(axis=0)
                if not last and (total < full * most).all():
                    rest += [pool[i] for i in held]
                    continue
                rows += [(serial, k, *pool[i]) for k, i in enumerate(held)]
                serial += 1
            columns = list(zip(*rows)) if rows else [[] for _ in _SCHEMA]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA), rest

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for k, (first, n, loss) in enumerate(pieces(text.as_py(), limits[0], path)):
                    pool.append((doc_id, k, first, n, loss))
                if len(pool) >= most_held:
                    out, rest = place(False)
                    yield out
                    if len(rest) > most_held // 2:
                        pool = rest
                        yield place(True)[0]
                        rest = []
                    pool = rest
        if pool:
            yield place(True)[0]

    return run


def pack_texts(
    df: DataFrame, doc_id: Column, text: Column, capacity: int, max_segments: int, max_loss: int | None = None, vocabulary: str = DEFAULT_VOCABULARY, pool: int = POOL, full: float = FULL
) -> DataFrame:
    """One row per placed text or piece: container, position in it, token range, loss-bearing tokens.

    pool is how many examples a task has in hand at once, which bounds its
    memory; full is the share of any limit from which a container is closed
    rather than unpacked for the next pool.
    """
    limits = (capacity, max_segments, capacity if max_loss is None else max_loss)
    if min(limits) < 1 or pool < 1:
        raise ValueError("all limits must be at least 1")
    two = df.select(doc_id.cast("bigint").alias("doc_id"), text.alias("text"))
    return two.mapInArrow(_pack_split(limits, vocabulary, pool, full), PLACED)
