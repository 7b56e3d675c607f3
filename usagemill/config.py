"""Options from layered JSON documents: later layers go over earlier ones."""

from __future__ import annotations

import json
from pathlib import Path


def layered(document: dict, command: str, agent: str | None = None) -> dict:
    """defaults, then the command's, then the agent's defaults, then the agent's for the command."""
    own = (document.get("agents") or {}).get(agent) or {} if agent else {}
    layers = [document.get("defaults"), (document.get("commands") or {}).get(command), own.get("defaults"), (own.get("commands") or {}).get(command)]
    out: dict = {}
    for layer in layers:
        out |= {k: v for k, v in (layer or {}).items() if v is not None}
    return out


def load(*paths: str) -> dict:
    """Files merged section by section; a missing file is no layer, a later file goes over an earlier one."""
    out: dict = {}
    for path in paths:
        if Path(path).exists():
            _over(out, json.loads(Path(path).read_text()))
    return out


def _over(base: dict, top: dict) -> None:
    for k, v in top.items():
        if isinstance(v, dict) and isinstance(base.get(k), dict):
            _over(base[k], v)
        else:
            base[k] = v
