"""Token counts and token boundaries of whole texts, with public vocabularies.

The tokenizer is a byte-level BPE read from a vocabulary file whose path is a
parameter. It is loaded once per Python worker. Texts are never cut before
they are encoded, and special tokens' strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import os

import numpy as np

DEFAULT_VOCABULARY = os.environ.get("USAGEMILL_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the splitting pattern the public vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict[str, "ByteTokenizer"] = {}


class ByteTokenizer:
    """Encodes text to ids and tells how many bytes each token spans."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for piece, rank in ranks.items():
            self.width[rank] = len(piece)

    def ids(self, text: str) -> np.ndarray:
        return self.core.encode_to_numpy(text, disallowed_special=()).astype(np.int64)

    def count(self, text: str | None) -> int:
        return len(self.core.encode_ordinary(text)) if text else 0

    def ends(self, text: str | None) -> np.ndarray:
        """The byte offset (in UTF-8) at which each token of text ends."""
        if not text:
            return np.zeros(0, dtype=np.int64)
        return np.cumsum(self.width[self.ids(text)])


def tokenizer(path: str = DEFAULT_VOCABULARY) -> ByteTokenizer:
    if path not in _LOADED:
        _LOADED[path] = ByteTokenizer(path)
    return _LOADED[path]
