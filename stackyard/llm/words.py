"""Words and word shingles of many texts at once, as 64-bit hashes (numpy, inside tasks).

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z are lower-cased.
The hash of a word is a polynomial over its bytes, taken from prefix sums over
the whole slab, so no Python object is made per word.
"""

from __future__ import annotations

import numpy as np

SLAB_BYTES = 1 << 20

_U = np.uint64


def _table() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    values = rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return values, space


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_M = 0x9E3779B97F4A7C15
_M_INV = pow(_M, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


class WordHasher:
    """Hashes the words of lists of texts; holds the power tables."""

    def __init__(self):
        self.values, self.space = _table()
        self.powers = self.inverse = np.ones(1, _U)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            n = max(n, SLAB_BYTES + SLAB_BYTES // 2)
            self.powers, self.inverse = _powers(_M, n), _powers(_M_INV, n)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(hashes, bounds)``: words of text i are ``hashes[bounds[i]:bounds[i + 1]]``."""
        raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8) if raw else np.zeros(0, np.uint8)
        if not len(buf):
            return np.zeros(0, _U), np.zeros(len(texts) + 1, np.int64)
        self._grow(len(buf))
        space = self.space[buf]
        edges = np.flatnonzero(np.diff(space, prepend=True))
        starts, ends = edges[0::2], edges[1::2]
        sums = np.cumsum(self.values[buf] * self.powers[:len(buf)], dtype=_U)
        before = np.where(starts > 0, sums[np.maximum(starts, 1) - 1], _U(0))
        hashes = mix((sums[ends - 1] - before) * self.inverse[starts])
        return hashes, np.searchsorted(starts, offsets)

    def shingle_sets(self, texts: list[str], width: int) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text.

        With fewer words than ``width`` the whole sequence is one shingle;
        without words the set is empty.
        """
        hashes, bounds = self.words(texts)
        factors = mix(np.arange(1, width + 1, dtype=_U) * _U(_M)) | _U(1)
        n = len(hashes)
        rolled = np.zeros(max(n - width + 1, 0), _U)
        for j in range(width):
            rolled += hashes[j:j + len(rolled)] * factors[j]
        rolled = mix(rolled)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= width:
                out.append(np.unique(rolled[a:b - width + 1]))
            elif b > a:
                short = (hashes[a:b] * factors[:b - a]).sum(dtype=_U) + _U(b - a)
                out.append(mix(np.array([short], _U)))
            else:
                out.append(np.zeros(0, _U))
        return out


def slabs(sizes: list[int], limit: int = SLAB_BYTES):
    """Cuts ``range(len(sizes))`` into runs of at most ``limit`` in total (one item at least)."""
    start, total = 0, 0
    for i, s in enumerate(sizes):
        if i > start and total + s > limit:
            yield start, i
            start, total = i, 0
        total += s
    if start < len(sizes):
        yield start, len(sizes)
