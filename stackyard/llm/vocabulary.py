"""Byte-level BPE vocabularies as arrays, for merging many words at once.

A merge joins two adjacent tokens whose bytes together are a token.  Its rank
is that of the joined token for rank files, and its place in the merge list
for ``tokenizers`` files.
"""

from __future__ import annotations

import base64
import json

import numpy as np

NONE = np.int64(1) << 30   # the rank of a pair that does not merge
_SHIFT = np.int64(20)


class Vocabulary:
    """``tokens[id]`` is the bytes of a token; merges are sorted by pair."""

    def __init__(self, tokens: dict[int, bytes], merges: list[tuple[int, int, int, int]]):
        self.tokens = tokens
        self.of_byte = np.full(256, -1, np.int64)
        for i, b in tokens.items():
            if len(b) == 1:
                self.of_byte[b[0]] = i
        table = np.array(merges, np.int64).reshape(-1, 4)
        pairs = (table[:, 0] << _SHIFT) | table[:, 1]
        order = np.argsort(pairs)
        self.pairs, self.ranks, self.joined = pairs[order], table[order, 2], table[order, 3]

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``NONE`` if there is none) and joined token of pairs; a token -1 never merges."""
        key = (left.astype(np.int64) << _SHIFT) | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        found = (self.pairs[at] == key) & (left >= 0) & (right >= 0)
        return np.where(found, self.ranks[at], NONE), np.where(found, self.joined[at], -1)


def from_ranks(path: str) -> Vocabulary:
    """A file of base64 tokens and ranks; ids are ranks."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    merges = []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                merges.append((left, right, rank, rank))
    return Vocabulary({r: t for t, r in ranks.items()}, merges)


def printable_bytes() -> dict[str, int]:
    """Character -> byte of the printable alphabet of byte-level ``tokenizers`` files.

    Printable Latin-1 bytes stand for themselves, the others for the code points
    from 256 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def from_json(path: str) -> tuple[Vocabulary, list[str]]:
    """A byte-level BPE file of ``tokenizers``, and the special strings it cuts out of texts."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain, normalizer = spec["pre_tokenizer"], spec["normalizer"]
    if plain["type"] != "ByteLevel" or plain["add_prefix_space"] or normalizer:
        raise ValueError("not a plain byte-level vocabulary")
    alphabet = printable_bytes()
    special = {t["id"]: t["content"] for t in spec["added_tokens"]}
    ids = spec["model"]["vocab"]
    tokens = {i: bytes(alphabet[c] for c in t) for t, i in ids.items() if i not in special}
    merges = []
    for rank, merge in enumerate(spec["model"]["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        merges.append((ids[left], ids[right], rank, ids[left + right]))
    return Vocabulary(tokens, merges), list(special.values())
