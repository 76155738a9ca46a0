"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor when the smallest hash among its inner
s-mers stands at its first or last place.  That depends on the k-mer alone, so
text that two documents share gives the same anchors in both, whatever
stands around it.  About 2 / (k - s + 1) of all places are anchors, and no
stretch of text is without one for long.

A fingerprint is all distinct anchors of a text, each with its first place, so
it grows with the text.  Two fingerprints are compared by position: of the
anchors of both together, the share that both hold in the same order of places.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackyard.llm.common import shuffle_partitions, texts
from stackyard.llm.words import mix

K, S = 24, 9
OUT_BYTES = 1 << 24   # of fingerprints in a batch that goes out
_ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_U = np.uint64


def syncmers(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, places)`` of all closed syncmers, in text order.

    A text shorter than ``k`` is one anchor at 0; an empty one has none.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(_U)
    n = len(points)
    if n < k:
        whole = hashlib.blake2b(points.tobytes(), digest_size=8).digest() if n else b""
        return np.frombuffer(whole, "<u8").astype(_U), np.zeros(min(n, 1), np.int64)
    inner = np.zeros(n - s + 1, _U)
    for j in range(s):
        inner = inner * _U(_ROUNDS[0]) + points[j:n - s + 1 + j]
    inner = mix(inner)
    width, least, have = k - s + 1, inner, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:len(least) - step], least[step:])
        have += step
    first, last = inner[:len(least)], inner[width - 1:]
    at = np.flatnonzero((least == first) | (least == last))
    # the hash of the k-mer from s-mers that cover it
    whole = np.zeros(len(at), _U)
    for offset in [*range(0, k - s, s), k - s]:
        whole = mix(whole * _U(_ROUNDS[1]) + inner[at + offset] + _U(_ROUNDS[2]))
    return whole, at


def fingerprint(text: str) -> np.ndarray:
    """``int64[n, 2]``: all distinct anchor hashes (32 bits) in order, each with its first place."""
    hashes, places = syncmers(text)
    kept, first = np.unique(hashes >> _U(32), return_index=True)
    return np.array([kept.astype(np.int64), places[first]]).T


def as_text(prints: np.ndarray) -> str:
    """``hash:place`` of each anchor, hexadecimal, joined by commas."""
    n = len(prints)
    if not n:
        return ""
    digits = [np.frombuffer(c.astype(">u4").tobytes().hex().encode(), np.uint8).reshape(n, 8) for c in prints.T]
    width = max(int(prints[:, 1].max()).bit_length() + 3 >> 2, 1)
    out = np.empty((n, width + 10), np.uint8)
    out[:, :8], out[:, 8], out[:, 9:-1], out[:, -1] = digits[0], ord(":"), digits[1][:, 8 - width:], ord(",")
    kept = np.ones(out.shape, bool)   # but zeros in front of a place
    kept[:, 9:-2] = prints[:, 1:] >> np.arange(4 * width - 4, 0, -4) > 0
    return out[kept][:-1].tobytes().decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; 1 for equal fingerprints, also for two empty ones."""
    a, b = (np.asarray(prints, np.int64).reshape(-1, 2) for prints in (a, b))
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(b[:, 0], a[:, 0]), len(b) - 1)
    both = b[at, 0] == a[:, 0]
    shared = b[at[both], 1][np.argsort(a[both, 1])]
    total = len(a) + len(b) - len(shared)
    if (np.diff(shared) > 0).all():
        return len(shared) / total
    tails: list[int] = []   # of rising chains of places
    for p in shared.tolist():
        if not tails or p > tails[-1]:
            tails.append(p)
        else:
            tails[bisect_left(tails, p)] = p
    return len(tails) / total


def edited(text: str, other: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of ``other``."""
    half = len(text) // 2
    return text[:len(text) - half] + other[:half]


def _router(bounds: list[int], edges: dict[int, int]):
    """Each row to its slice; rows with the first id of a slice also to the slice before."""
    table = np.array(bounds, np.int64)
    known = sorted((i, s) for i, s in edges.items() if i is not None)
    firsts = np.array([i for i, _ in known], np.int64)
    targets = np.array([s for _, s in known], np.int32)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            key = batch.column("id").to_numpy()
            own = np.searchsorted(table, key, side="right").astype(np.int32)
            at = np.minimum(np.searchsorted(firsts, key), len(firsts) - 1)
            copies = np.flatnonzero(firsts[at] == key)
            for rows, target, edge in ((None, own, False), (copies, targets[at[copies]], True)):
                part = batch if rows is None else batch.take(pa.array(rows))
                if part.num_rows:
                    yield pa.record_batch(
                        [*part.columns, pa.array(target), pa.array(np.full(part.num_rows, edge))],
                        names=[*part.schema.names, "slice", "edge"])
    return run


def _printed(out: list[tuple]):
    import pyarrow as pa
    columns = list(zip(*out)) if out else [()] * 7
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=[
        "id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _printer(batches):
    held = None   # the last row, which waits for the next one
    for batch in batches:
        out, size = [], 0
        for key, null, text, part, edge in zip(*(batch.column(c).to_pylist() for c in (
                "id", "null_id", "text", "slice", "edge"))):
            row = (None if null else key, text, part, edge, fingerprint(text))
            if held is not None and not held[3] and held[2] == part:
                doc, whole, _, _, prints = held
                changed = edited(whole, text)
                other = fingerprint(changed)
                out.append((doc, len(whole), hashlib.sha256(changed.encode()).hexdigest(), as_text(prints),
                            as_text(other), likeness(prints, other), likeness(prints, row[4])))
                size += len(out[-1][3]) + len(out[-1][4])
                if size > OUT_BYTES:
                    yield _printed(out)
                    out, size = [], 0
            held = row
        yield _printed(out)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``.

    The next document is that of the next id (the first after the last; the
    row itself in a table of one).  Null ids come first; rows of one id follow
    each other by text.  Null texts are empty; an empty text has an empty
    fingerprint, like only another empty one.  An empty table gives no rows.

    Rows are dealt out by ranges of the id, and the first rows of each range
    also go to the range before, so one shuffle of the texts finds every next document.
    Ranges come from quantiles of the ids; one id stays in one range.
    """
    spark = docs.sparkSession
    lowest = -(1 << 63)
    rows = texts(docs, id_col, text_col).select(
        F.coalesce("id", F.lit(lowest)).alias("id"), F.col("id").isNull().alias("null_id"), "text")
    n = 2 * shuffle_partitions(spark)
    marks, least = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 100 * n), F.min("id")).first()
    # a bound is an id of the table, the first of its range
    bounds = sorted(set(marks or []) - {least})
    edges = {b: i for i, b in enumerate(bounds)} | {least: len(bounds)}
    routed = rows.mapInArrow(_router(bounds, edges),
                             "id bigint, null_id boolean, text string, slice int, edge boolean")
    ordered = routed.repartitionById(len(bounds) + 1, "slice").sortWithinPartitions("slice", "edge", "id", "text")
    return ordered.mapInArrow(
        _printer, "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_col)
