"""Length-delimited wire messages inside database blobs, read without a descriptor."""

from __future__ import annotations

from collections.abc import Iterator

#: Field numbers of the messages.
CHAT, USAGE, INFO, MODEL_ID, MODEL_NAMES = 1, 4, 9, 3, (19, 21)
USAGE_FIELDS = {"input": 2, "total_output": 3, "cache_creation": 4, "cache_read": 5, "reasoning": 9, "visible_output": 10}
USAGE_IDS = {"response": 11, "provider_message": 12, "message": 7}
STEP_TIMES, STEP_USAGE, STEP_MODEL = (8, 1), 9, 24
STEP_INDICES, RETRIES, STEP_RETRIES, RETRY_USAGE, USAGE_MODEL = 2, 17, 28, 2, 1


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("varint")
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value & 0xFFFFFFFFFFFFFFFF, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field; numbers as they are, the rest as bytes."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
            if len(value) < size:
                raise ValueError("cut short")
        else:
            raise ValueError("wire type")
        yield tag >> 3, value


def message(data: object) -> dict[int, list]:
    out: dict[int, list] = {}
    if isinstance(data, bytes):
        for n, v in fields(data):
            out.setdefault(n, []).append(v)
    return out


def first(m: dict[int, list], *numbers: int) -> object:
    return next((m[n][0] for n in numbers if n in m), None)


def text(v: object) -> str | None:
    return v.decode("utf-8", "replace") or None if isinstance(v, bytes) else None


def seconds(v: object) -> int | None:
    """Milliseconds of a (seconds, nanoseconds) message."""
    m = message(v)
    s = first(m, 1)
    return None if not isinstance(s, int) else s * 1000 + (first(m, 2) or 0) // 1_000_000


def usage(data: object) -> dict[str, object]:
    """Counters, the id that goes first with its kind, and ids: all of them, each with its kind."""
    m = message(data)
    out: dict[str, object] = {k: first(m, n) if isinstance(first(m, n), int) else None for k, n in USAGE_FIELDS.items()}
    out["ids"] = []
    for kind, n in USAGE_IDS.items():
        if t := text(first(m, n)):
            out["ids"].append(f"{kind}:{t}")
            if "id" not in out:
                out["id"], out["id_kind"] = t, kind
    out["counts"] = tuple(first(m, n) or 0 for n in (USAGE_MODEL, *USAGE_FIELDS.values()))
    return out


def retries(blobs: list, primary: dict[str, object]) -> list[dict[str, object]]:
    """Usage of each attempt, without the one that repeats the primary usage. Torn ones are skipped."""
    out = []
    for blob in blobs:
        try:
            if isinstance(u := first(message(blob), RETRY_USAGE), bytes):
                out.append(usage(u))
        except ValueError:
            continue
    mirror = next((i for i, u in enumerate(out) if u["counts"] == primary["counts"] and set(u["ids"]) <= set(primary["ids"])), None)
    return [u for i, u in enumerate(out) if i != mirror]


def indices(values: list) -> list[int]:
    """Numbers of a repeated field, single or packed."""
    out = []
    for v in values:
        at = 0
        while isinstance(v, bytes) and at < len(v):
            try:
                x, at = varint(v, at)
            except ValueError:
                break
            out.append(x)
        if isinstance(v, int):
            out.append(v)
    return out


def generation(data: bytes | None) -> dict[str, object] | None:
    """Model, time and usage of a generation blob, None if it is torn."""
    try:
        root = message(data)
        chat = message(first(root, CHAT))
        u = usage(first(chat, USAGE))
        model = text(first(chat, *MODEL_NAMES)) or text(first(chat, MODEL_ID))
        return u | {"model": model, "ms": seconds(first(message(first(chat, INFO)), 4)), "retries": retries(chat.get(RETRIES, []), u), "steps": indices(root.get(STEP_INDICES, []))}
    except ValueError:
        return None


def step(data: bytes | None) -> dict[str, object] | None:
    try:
        m = message(data)
        info = message(first(m, STEP_MODEL))
        u = usage(first(m, STEP_USAGE))
        return u | {"model": text(first(info, 12, 8, 1)), "ms": seconds(first(m, *STEP_TIMES)), "retries": retries(m.get(STEP_RETRIES, []), u)}
    except ValueError:
        return None
