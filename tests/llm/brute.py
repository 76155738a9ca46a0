"""Plain Python models of the operators, for small inputs."""

from __future__ import annotations

import re

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


def shingles(text: str | None, width: int = 5) -> frozenset:
    w = words(text)
    if not w:
        return frozenset()
    if len(w) < width:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1))


def near_components(docs: list[tuple], percent: int = 75) -> dict:
    """doc_id -> (n_shingles, component_id, kept) of ``(doc_id, text)`` with distinct ids."""
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by_size = sorted((d for d in sets if sets[d]), key=lambda d: len(sets[d]))
    for i, a in enumerate(by_size):
        for b in by_size[i + 1:]:
            if 100 * len(sets[a]) < percent * len(sets[b]):
                break
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}
