"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text and one on toxic
text.  A window of a text that holds toxic wording compresses shorter with the
second.  Both contain the same trained ordinary content, so that other wording
costs the same under both; to the toxic one is added, after it, the wording of
toxic documents that ordinary documents lack (runs of byte 6-grams in far
more toxic than ordinary documents).

Whole texts are scored in overlapping windows of several sizes.  The differences
of the two lengths, summed up per document (largest, mean of the three
largest, mean, share and number of telling windows), are calibrated to a
probability by a logistic curve.  The curve is fitted on features from
dictionaries that did not see the document (two-fold cross-fitting).

The model is fitted on a bounded sample of labelled rows (``MAX_TOXIC`` and
``MAX_ORDINARY`` rows of up to ``MAX_SAMPLE_CHARS`` characters); scoring is one
map over all rows, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackyard.llm.common import crc_mod, texts

MAX_TOXIC, MAX_ORDINARY, MAX_SAMPLE_CHARS = 1500, 3000, 32768
THRESHOLD = 0.3
WINDOWS, OVERLAP, LEVEL = (64, 128), 16, 3
GRAM = 6
GRAM_SHARE, GRAM_RATIO = 0.02, 30.0   # of toxic documents; toxic share against ordinary share
LEAST_DOCS = 5
DICT_BYTES, WORDING_BYTES, DICT_SAMPLES = 32768, 8192, 30000
_PIECE = re.compile(rb"[a-z\x80-\xff]+")


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    center: tuple
    scale: tuple
    weights: tuple
    prior: float

    @property
    def usable(self) -> bool:
        return bool(self.weights)


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def _grams(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = max(len(a) - GRAM + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(GRAM):
        out = (out << np.uint64(8)) | a[j:j + n]
    return out


def _known(grams: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(grams), bool)
    at = np.minimum(np.searchsorted(among, grams), len(among) - 1)
    return among[at] == grams


def _toxic_grams(toxic: list[np.ndarray], ordinary: list[np.ndarray]) -> np.ndarray:
    """Sorted 6-grams found in far more toxic than ordinary documents (given as sets of grams)."""
    grams, docs = np.unique(np.concatenate(toxic), return_counts=True)
    often = docs >= max(LEAST_DOCS, GRAM_SHARE * len(toxic))
    grams, docs = grams[often], docs[often]
    others = np.zeros(len(grams), np.int64)
    for seen in ordinary:
        others[np.searchsorted(grams, seen[_known(seen, grams)])] += 1
    return grams[docs / len(toxic) > GRAM_RATIO * (others + 0.5) / len(ordinary)]


def _wording(toxic: list[bytes], grams: np.ndarray) -> bytes:
    """The words that those grams run through, the most frequent last."""
    found = Counter()
    for t in toxic:
        at = np.flatnonzero(_known(_grams(t), grams))
        if len(at):
            first = at[np.concatenate([[True], np.diff(at) > 1])]
            last = at[np.concatenate([np.diff(at) > 1, [True]])]
            found.update({max(_PIECE.findall(t[a:z + GRAM]) or [b""], key=len)
                          for a, z in zip(first.tolist(), last.tolist())})
    words = [w for w, n in sorted(found.items(), key=lambda x: (x[1], x[0]))
             if len(w) >= 4 and n >= max(len(toxic) / 300, 2)]
    return b" " + b" ".join(words)[-WORDING_BYTES:] + b" "


def _ordinary_content(ordinary: list[bytes]) -> bytes:
    """A dictionary trained on windows spread evenly over ordinary documents."""
    import zstandard as zs
    samples = [t[i:i + 128] for t in ordinary for i in range(0, len(t), 128)]
    samples = samples[::len(samples) // DICT_SAMPLES + 1]
    size = min(DICT_BYTES, sum(map(len, samples)) // 8)
    try:
        return zs.train_dictionary(size, samples).as_bytes()[-3 * size // 4:]
    except (zs.ZstdError, ValueError):  # too few samples to train on: they are the dictionary
        return b"".join(samples)[-DICT_BYTES:]


class _Scorer:
    """Length differences of a text's windows under the two dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard as zs
        self.compress = []
        for content in (ordinary, toxic):
            d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compress.append(zs.ZstdCompressor(
                level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False,
                write_dict_id=False).compress)

    def features(self, text: str) -> list[float]:
        data = _bytes(text)
        ordinary, toxic = self.compress
        out = []
        for size in WINDOWS:
            d = np.sort(np.array([len(ordinary(w)) - len(toxic(w)) for w in
                                  [data[max(i - OVERLAP, 0):i + size]
                                   for i in range(0, max(len(data), 1), size)]], np.float64))
            out += [d[-1], d[-3:].mean(), d.mean(), (d >= 3).mean(), np.log1p((d >= 4).sum())]
        return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple:
    """Centre, scale and weights of a ridge logistic curve (damped Newton steps)."""
    center, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[np.ones(len(x)), (x - center) / scale]
    ridge = np.r_[1e-6, np.ones(x.shape[1])]
    w = np.r_[np.log(y.mean() / (1 - y.mean())), np.zeros(x.shape[1])]
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(hessian, a.T @ (p - y) + ridge * w)
        w -= step * min(1.0, 1.0 / np.abs(step).max(initial=1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(center), tuple(scale), tuple(w)


def fit(sample: list[tuple[str, int]]) -> ToxicityModel:
    """Model of labelled ``(text, 0 or 1)``; with fewer than 4 of a class it only knows the share."""
    by_class = {c: [t for t, y in sample if y == c] for c in (0, 1)}
    prior = len(by_class[1]) / max(len(sample), 1)
    if min(map(len, by_class.values())) < 4:
        return ToxicityModel(b"", b"", (), (), (), prior)
    raw = {c: [_bytes(t) for t in v] for c, v in by_class.items()}
    grams = {c: [np.unique(_grams(t)) for t in v] for c, v in raw.items()}
    content = _ordinary_content(raw[0])

    def dictionaries(part: slice) -> tuple[bytes, bytes]:
        telling = _toxic_grams(grams[1][part], grams[0][part])
        return content, content + _wording(raw[1][part], telling)

    x, y = [], []
    for fold in (0, 1):
        scorer = _Scorer(*dictionaries(slice(1 - fold, None, 2)))
        for c in (0, 1):
            x += [scorer.features(t) for t in by_class[c][fold::2]]
            y += [c] * len(by_class[c][fold::2])
    return ToxicityModel(*dictionaries(slice(None)), *_logistic(np.array(x), np.array(y, float)), prior)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str,
                    max_toxic: int, max_ordinary: int) -> list[tuple[str, int]]:
    """About ``max_toxic`` and ``max_ordinary`` labelled texts, chosen by a hash of the id.

    Rows whose crc32(id as text) mod 4 is 2 are held out and never sampled.
    """
    known = (labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("toxic").alias("y"))
             .filter("id IS NOT NULL AND y IN (0, 1)").filter(crc_mod("id", 4) != 2)
             .groupBy("id").agg(F.max("y").alias("y")))
    n = {r.y: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("y") == 1, max_toxic / max(n.get(1, 0), 1)).otherwise(
        max_ordinary / max(n.get(0, 0), 1))
    picked = known.filter(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_000)) < share * 1_000_000)
    rows = (texts(docs, id_col, text_col).filter(F.length("text") <= MAX_SAMPLE_CHARS)
            .join(F.broadcast(picked), "id")  # bounded by the two limits
            .select("id", "text", "y").collect())
    return [(r.text, r.y) for r in sorted(rows, key=lambda r: (r.id, r.text))]


def score(model: ToxicityModel):
    """A column function: the score of a text column without nulls."""
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _Scorer(model.ordinary, model.toxic) if model.usable else None
        for text in batches:
            if scorer is None:
                yield pd.Series(np.full(len(text), model.prior))
                continue
            x = np.array([scorer.features(t) for t in text]).reshape(len(text), -1)
            a = np.c_[np.ones(len(x)), (x - np.array(model.center)) / np.array(model.scale)]
            yield pd.Series(1 / (1 + np.exp(-np.clip(a @ np.array(model.weights), -30, 30))))
    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY) -> ToxicityModel:
    """The model of the labelled rows that are not held out."""
    return fit(labelled_sample(docs, labels, id_col, text_col, max_toxic, max_ordinary))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``id_col, held_out, score, predicted``.

    Null and empty texts are scored as the empty text; a null id is not held
    out.  Repeated rows get the same score.  Without usable labels every
    score is the share of toxic labels.  An empty table gives no rows.
    """
    model = train(docs, labels, id_col, text_col)
    rows = texts(docs, id_col, text_col).select("id", score(model)("text").alias("score"))
    return rows.select(
        F.col("id").alias(id_col), F.coalesce(crc_mod("id", 4) == 2, F.lit(False)).alias("held_out"),
        "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    model = train(docs, labels, id_col, text_col)
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(doc, score(model)(text).alias("score")).filter(F.col("score") < threshold).select("doc.*")
