"""Expected values from loops that share no code with the operators; long texts; empty tables."""

import hashlib

import numpy as np
import public_tokenizers
import zstandard
from conftest import SMALL
from edge import BASE, table

import corpus_pipeline as pipeline
from stackyard.llm import exact_dedup, minmax_dedup, syncmers, token_counts, toxicity
from stackyard.llm.bestfit_packing import pack
from stackyard.llm.bpe_codec import encode
from stackyard.tables import load

MASK = (1 << 64) - 1


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def anchors(text, k=24, s=9):
    """``(hash, place)`` of the closed syncmers, k-mer by k-mer with plain integers."""
    if len(text) < k:
        if not text:
            return []
        points = b"".join(ord(c).to_bytes(8, "little") for c in text)
        return [(int.from_bytes(hashlib.blake2b(points, digest_size=8).digest(), "little"), 0)]
    out = []
    for at in range(len(text) - k + 1):
        inner = []
        for i in range(at, at + k - s + 1):
            h = 0
            for c in text[i:i + s]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c)) & MASK
            inner.append(mixed(h))
        if min(inner) in (inner[0], inner[-1]):
            whole = 0
            for j in (0, 9, k - s):
                whole = mixed((whole * 0xC2B2AE3D27D4EB4F + inner[j] + 0x165667B19E3779F9) & MASK)
            out.append((whole, at))
    return out


def prints(text):
    first = {}
    for h, at in anchors(text):
        first.setdefault(h >> 32, at)
    return first


def chain(a, b):
    """Likeness: the longest run of shared anchors in the same order of places, by dynamic programming."""
    if not a or not b:
        return float(len(a) == len(b))
    shared = [b[h] for h in sorted((h for h in a if h in b), key=a.get)]
    best = []
    for i, p in enumerate(shared):
        best.append(1 + max([best[j] for j in range(i) if shared[j] < p], default=0))
    return max(best, default=0) / (len(a) + len(b) - len(shared))


def test_fingerprints_equal_plain_loops(spark):
    rows = [(r.doc_id, (r.text or "")[:700]) for r in load(spark, SMALL, "documents").limit(25).collect()]
    rows += [(900, BASE), (901, BASE[::-1]), (902, "日本語 😀 " * 30), (903, ""), (904, "short"), (905, BASE)]
    rows = sorted(dict(rows).items())
    got = {r.doc_id: r for r in syncmers.fingerprints(table(spark, rows)).collect()}
    for (key, text), (_, following) in zip(rows, [*rows[1:], rows[0]]):
        half = len(text) // 2
        changed = text[:len(text) - half] + following[:half]
        own, other, after = prints(text), prints(changed), prints(following)
        r = got[key]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert {int(h, 16): int(p, 16) for h, _, p in (x.partition(":") for x in r.fingerprint.split(",") if x)} == own
        assert abs(r.near_edited - chain(own, other)) < 1e-12 and abs(r.near_next - chain(own, after)) < 1e-12


def test_toxicity_scores_equal_plain_compression(spark):
    """Scores from the model's dictionaries and weights by a loop of its own over windows."""
    docs, labels = load(spark, SMALL, "documents"), load(spark, SMALL, "labels")
    model = toxicity.train(docs, labels)
    assert model.usable
    packers = []
    for content in (model.ordinary, model.toxic):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=toxicity.LEVEL)
        packers.append(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=held, write_checksum=False,
                                                write_content_size=False, write_dict_id=False))
    scored = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    for doc in docs.limit(60).collect():
        data, x = (doc.text or "").lower().encode(), []
        for size in toxicity.WINDOWS:
            gains = []
            for i in range(0, max(len(data), 1), size):
                window = data[max(i - toxicity.OVERLAP, 0):i + size]
                gains.append(len(packers[0].compress(window)) - len(packers[1].compress(window)))
            gains.sort()
            top = gains[-3:]
            x += [gains[-1], sum(top) / len(top), sum(gains) / len(gains), sum(g >= 3 for g in gains) / len(gains),
                  np.log1p(sum(g >= 4 for g in gains))]
        line = model.weights[0] + sum(w * (v - c) / s for w, v, c, s in zip(model.weights[1:], x, model.center, model.scale))
        score = 1 / (1 + np.exp(-line))
        assert abs(scored[doc.doc_id].score - score) < 1e-9
        assert scored[doc.doc_id].predicted == int(score >= 0.3)


def test_texts_of_five_million_characters(spark):
    long = " ".join(f"w{i % 9973}x{i % 31}" for i in range(620_000))
    assert len(long) > 5_000_000
    docs = table(spark, [(1, long), (2, long), (3, long + " end of it all"), (4, "short text")])
    exact = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()}
    assert exact == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 1)}
    near = {r.doc_id: r.component_id for r in minmax_dedup.near_duplicates(docs).collect()}
    assert near == {1: 1, 2: 1, 3: 1, 4: 4}
    byte = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    counted = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, *byte).collect()}
    encoded = {r.doc_id: len(r.ids) // 4 for r in encode(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    assert counted == encoded and counted[1] > 1_000_000
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append((p.piece, p.start, p.length))
    for own in by_doc.values():
        own.sort()
        assert [s for _, s, _ in own] == [sum(n for _, _, n in own[:i]) for i in range(len(own))]
        assert all(n == 2048 for _, _, n in own[:-1])
    assert sum(n for _, _, n in by_doc[1]) < sum(n for _, _, n in by_doc[3])


def test_every_stage_takes_an_empty_table(spark):
    docs = load(spark, SMALL, "documents").limit(0)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns
