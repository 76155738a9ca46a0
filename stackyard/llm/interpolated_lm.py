"""Bigram language model by deleted interpolation.

P(w | u) = l2 c(uw)/c(u) + l1 c(w)/N + l0 / (V + 1), where the weights depend on
how often the context u occurs (buckets by powers of two).  They are learned by
expectation-maximisation on a part of the training documents whose tokens
are deleted from the counts meanwhile; the scores then use all training counts.

Counts, contexts and vocabulary grow with the corpus, so none of them is sent to
all tasks.  Documents are read in blocks of bounded size.  A block asks, once for
each distinct word and bigram in it, for the count over all documents:

1. every block adds up its own counts and sends its keys, sorted, to the tasks
   that own a range of keys (packed arrays, one row per block and range; a word
   pair that is everywhere arrives once per block);
2. the owner adds the counts up and answers each block in the order asked;
3. a block meets its answers again and scores its documents.

The held-out part asks the same way for counts without it, which gives the
table on which expectation-maximisation runs, as Spark aggregates; only the weights
reach the driver.

Words and bigrams are 64-bit hashes.  Blocks follow the splits of the input,
which is read twice and must give the same rows each time (files, or a table that
was written); a block that does not find its answers fails the job.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackyard.llm.common import crc_mod, lean_memory, saved, shuffle_partitions, texts, worker_state
from stackyard.llm.words import WordHasher, mix, slabs

BLOCK_CHARS = 1 << 21      # texts of one block, together
RANGE_BYTES = 1 << 23      # text bytes per range of keys
HELD_PART = 8              # one training document in so many teaches the weights
BUCKETS = 32               # of context frequency: 0, 1, 2-3, 4-7, ...
ITERATIONS, TOLERANCE, FLOOR = 15, 1e-3, 1e-4
END = np.uint64(0x5851F42D4C957F2D)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_TEST, _CORE, _WEIGHTS = 0, 1, 2


def _pack(a: np.ndarray) -> bytes:
    """An integer array, byte plane by byte plane, compressed."""
    import zstandard
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    import zstandard
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _pack_sorted(a: np.ndarray) -> bytes:
    return _pack(np.diff(a, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


class _Tokens:
    """Tokens of a block: distinct words, and the distinct bigrams, by sorted key."""

    def __init__(self, words: np.ndarray, places: np.ndarray, sizes: np.ndarray):
        """``words`` sorted keys; ``places`` of each token in them; ``sizes`` tokens per document."""
        self.words, self.right, self.sizes = words, places.astype(np.int32), sizes
        self.starts = np.cumsum(sizes) - sizes
        self.left = np.roll(self.right, 1)
        # the context of a first word is the end of a document: as frequent as first words are
        self.left[self.starts] = np.searchsorted(words, END)
        pairs = mix(words[self.left] * _A + mix(words[self.right] + _B))
        self.pairs, self.first, self.pair = np.unique(pairs, return_index=True, return_inverse=True)
        self.first, self.pair = self.first.astype(np.int32), self.pair.astype(np.int32)

    @classmethod
    def of(cls, batch: list[str], hasher: WordHasher) -> "_Tokens":
        found, sizes = [], []
        for lo, hi in slabs([len(t) for t in batch]):
            hashes, bounds = hasher.words(batch[lo:hi])
            found.append(np.insert(hashes, bounds[1:], END))
            sizes.append(np.diff(bounds) + 1)
        words, places = np.unique(np.concatenate(found), return_inverse=True)
        return cls(words, places, np.concatenate(sizes))


def _parted(batches):
    """``(block id, ids, parts, texts)`` of blocks of bounded size, the same on every reading."""
    import xxhash
    from pyspark import TaskContext
    import pyarrow.compute as pc
    lean_memory()
    task, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        sizes = pc.utf8_length(batch.column("text")).to_pylist()
        for lo, hi in slabs(sizes, BLOCK_CHARS):   # only the rows of one block become Python objects
            ids, parts, text = (batch.column(c).slice(lo, hi - lo).to_pylist() for c in ("id", "part", "text"))
            name = f"{task} {number} {ids} {sizes[lo:hi]}"
            yield xxhash.xxh3_64_intdigest(name.encode()) >> 1, ids, parts, text
            number += 1


def _held_name(block: int) -> int:
    return block ^ (1 << 62)


def _asker(ranges: int):
    """Questions ``(owner, block, held, kind, keys, total, core)`` of each block."""
    edges = np.array([-(-(i << 64) // ranges) for i in range(1, ranges)], np.uint64)

    def rows(block, held, kind, keys, total, core):
        cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
        for owner, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if b > a:
                yield (owner, block, held, kind, _pack_sorted(keys[a:b]),
                       b"" if held else _pack(total[a:b]), b"" if held else _pack(core[a:b]))

    def run(batches):
        import pyarrow as pa
        hasher = worker_state("word_hasher", WordHasher)
        kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        names = ["owner", "block", "held", "kind", "keys", "total", "core"]
        for block, _, parts, text in _parted(batches):
            tokens = _Tokens.of(text, hasher)
            part = np.repeat(np.array(parts), tokens.sizes)
            out = []
            for kind, keys, place in ((0, tokens.words, tokens.right), (1, tokens.pairs, tokens.pair)):
                total, core = (np.bincount(place, w, len(keys)).astype(np.uint64)
                               for w in (part != _TEST, part == _CORE))
                out += rows(block, False, kind, keys, total, core)
            held = [t for t, p in zip(text, parts) if p == _WEIGHTS]
            if held:
                tokens = _Tokens.of(held, hasher)
                for kind, keys in ((0, tokens.words), (1, tokens.pairs)):
                    out += rows(_held_name(block), True, kind, keys, None, None)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
    return run


def _answer(table):
    """Counts over all blocks for one range of keys, and one row of its totals."""
    import pyarrow as pa
    lean_memory()
    columns = {n: table.column(n).to_pylist() for n in table.schema.names}
    owner, out, sums = columns["owner"][0], [], [0, 0, 0, 0]
    for kind in (0, 1):
        rows = [i for i, k in enumerate(columns["kind"]) if k == kind]
        if not rows:
            continue
        keys = [_unpack_sorted(columns["keys"][i]) for i in rows]
        lengths = [len(k) for k in keys]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        place, ends = place.astype(np.int32), np.cumsum(lengths)
        total, core = np.zeros(len(distinct), np.uint64), np.zeros(len(distinct), np.uint64)
        for i, k, end in zip(rows, lengths, ends):
            if not columns["held"][i]:
                at = place[end - k:end]   # keys of one block are distinct
                total[at] += _unpack(columns["total"][i], np.uint64)
                core[at] += _unpack(columns["core"][i], np.uint64)
        for i, k, end in zip(rows, lengths, ends):
            counts = (core if columns["held"][i] else total)[place[end - k:end]]
            out.append((columns["block"][i], columns["held"][i], kind, owner, _pack(counts), 0, 0, 0, 0))
        if kind == 0:
            sums = [int(total.sum()), int((total > 0).sum()), int(core.sum()), int((core > 0).sum())]
    out.append((-1, False, 0, owner, b"", *sums))
    kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 4)
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(zip(_ANSWER, kinds), zip(*out))})


_ANSWER = ("block", "held", "kind", "owner", "counts", "n_total", "v_total", "n_core", "v_core")


def _teller(held: bool):
    """Blocks as rows, to meet their answers: of the held-out part, or of all documents."""
    def run(batches):
        import pyarrow as pa
        hasher = worker_state("word_hasher", WordHasher)
        for block, ids, parts, text in _parted(batches):
            if held:
                block, text = _held_name(block), [t for t, p in zip(text, parts) if p == _WEIGHTS]
                ids = parts = []
            if not text:
                continue
            tokens = _Tokens.of(text, hasher)
            yield pa.record_batch([
                pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                pa.array([[p == _TEST for p in parts]], pa.list_(pa.bool_())),
                *(pa.array([x], pa.binary()) for x in (
                    _pack(tokens.sizes.astype(np.int64)), _pack_sorted(tokens.words),
                    _pack(tokens.right.astype(np.uint32))))],
                names=["block", "ids", "test", "sizes", "words", "places"])
    return run


def _met(told, answers) -> tuple[_Tokens, np.ndarray, np.ndarray]:
    """A block's tokens, and the counts of its words and bigrams."""
    lean_memory()
    if told.num_rows != 1:
        raise RuntimeError("blocks differ between two readings of the documents")
    row = told.slice(0, 1).to_pylist()[0]
    tokens = _Tokens(_unpack_sorted(row["words"]), _unpack(row["places"], np.uint32),
                     _unpack(row["sizes"], np.int64))
    counts = [[], []]
    for a in sorted(answers.to_pylist(), key=lambda a: a["owner"]):
        counts[a["kind"]].append(_unpack(a["counts"], np.uint64))
    words, pairs = (np.concatenate(c).astype(np.float64) if c else np.zeros(0) for c in counts)
    if len(words) != len(tokens.words) or len(pairs) != len(tokens.pairs):
        raise RuntimeError("blocks differ between two readings of the documents")
    return tokens, words, pairs


def _tuples(told, answers):
    """Distinct ``(pair, context, word, n)`` counts of a held-out block's tokens."""
    import pyarrow as pa
    tokens, words, pairs = _met(told, answers)
    often = np.bincount(tokens.pair, minlength=len(pairs))
    columns = [pairs, words[tokens.left[tokens.first]], words[tokens.right[tokens.first]]]
    columns = [c.astype(np.uint64) for c in columns]
    key = mix(mix(mix(columns[0] + _A) + columns[1]) + columns[2])
    _, first, place = np.unique(key, return_index=True, return_inverse=True)
    return pa.table({"pair": pa.array(columns[0][first].astype(np.int64)),
                     "context": pa.array(columns[1][first].astype(np.int64)),
                     "word": pa.array(columns[2][first].astype(np.int64)),
                     "n": pa.array(np.bincount(place, often).astype(np.int64))})


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2), at most ``BUCKETS - 1``."""
    return np.where(context > 0, np.minimum(np.floor(np.log2(np.maximum(context, 1))) + 1, BUCKETS - 1),
                    0).astype(np.int64)


def learn_weights(tuples: DataFrame, n: int, v: int, iterations: int = ITERATIONS) -> list[list[float]]:
    """Weights ``[l2, l1, l0]`` per bucket, by expectation-maximisation over counted tokens.

    A bucket without held-out tokens takes the weights of the nearest one that
    has some.  No weight is below ``FLOOR``.
    """
    bucket = (f"IF(context > 0, LEAST(CAST(FLOOR(LOG2(context) + 1e-12) AS INT) + 1, {BUCKETS - 1}), 0)")
    seen = saved(tuples.groupBy("pair", "context", "word").agg(F.sum("n").alias("n")).select(
        F.expr(bucket).alias("bucket"), "n",
        F.expr("IF(context > 0, pair / context, 0D)").alias("p2"),
        (F.col("word") / F.lit(float(max(n, 1)))).alias("p1")), "held-out-counts")
    p0 = 1.0 / (v + 1)
    weights = [[0.0, 0.5, 0.5]] + [[1 / 3, 1 / 3, 1 / 3] for _ in range(1, BUCKETS)]
    full: set[int] = set()
    for _ in range(iterations):
        l2, l1, l0 = (F.element_at(F.array(*[F.lit(w[i]) for w in weights]), F.col("bucket") + 1)
                      for i in range(3))
        a, b, c = l2 * F.col("p2"), l1 * F.col("p1"), l0 * F.lit(p0)
        sums = (seen.withColumns({"a": a, "b": b, "c": c}).withColumn("p", F.expr("a + b + c"))
                .groupBy("bucket").agg(*[F.expr(f"sum(n * {x} / p)").alias(x) for x in "abc"],
                                       F.sum("n").alias("all")).collect())
        change = 0.0
        for r in sums:
            new = [max(x / r["all"], FLOOR) for x in (r.a, r.b, r.c)]
            new = [x / sum(new) for x in new]
            change = max(change, *(abs(x - y) for x, y in zip(new, weights[r.bucket])))
            weights[r.bucket] = new
            full.add(r.bucket)
        if change < TOLERANCE:
            break
    return [weights[min(full, key=lambda f: abs(f - b))] if full else weights[b] for b in range(BUCKETS)]


def _scorer(weights: list[list[float]], n: int, v: int):
    table = np.array(weights)

    def run(told, answers):
        import pyarrow as pa
        tokens, words, pairs = _met(told, answers)
        left, right = tokens.left[tokens.first], tokens.right[tokens.first]
        context = words[left]
        l2, l1, l0 = table[bucket_of(context)].T
        ml2 = np.divide(pairs, context, out=np.zeros(len(pairs)), where=context > 0)
        logp = np.log10(l2 * ml2 + l1 * words[right] / max(n, 1) + l0 / (v + 1))
        base = np.log10((words + 1) / (n + v + 1))
        starts = tokens.starts
        return pa.table({
            "id": told.column("ids").combine_chunks().flatten(),
            "held_out": told.column("test").combine_chunks().flatten(),
            "n_tokens": pa.array(tokens.sizes),
            "n_known": pa.array(np.add.reduceat((words > 0).astype(np.int64)[tokens.right], starts)),
            "base_score": pa.array(np.add.reduceat(base[tokens.right], starts)),
            "score": pa.array(np.add.reduceat(logp[tokens.pair], starts))})
    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              modulus: int = 7, remainder: int = 2) -> DataFrame:
    """One row per input row: ``id_col, held_out, n_tokens, n_known, train_tokens,
    base_score, score`` (log10 probabilities of the text's words and one end).

    Rows whose crc32(id as text) mod ``modulus`` is ``remainder`` are held out;
    the others, rows without an id included, are counted.  Null and empty texts
    have the end only.  Repeated rows count as often as they occur.  An empty
    table gives no rows; without training rows every token has probability one.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    ranges = max(shuffle_partitions(spark), math.ceil(size / RANGE_BYTES))
    part = F.when(F.coalesce(crc_mod("id", modulus) == remainder, F.lit(False)), _TEST).when(
        F.pmod(F.xxhash64(F.lit("weights"), "id", "text"), F.lit(HELD_PART)) == 0, _WEIGHTS).otherwise(_CORE)
    rows = rows.select("id", part.alias("part"), "text")
    asked = rows.mapInArrow(_asker(ranges), "owner int, block bigint, held boolean, kind int, "
                            "keys binary, total binary, core binary")
    answers = saved(asked.groupBy("owner").applyInArrow(
        _answer, "block bigint, held boolean, kind int, owner int, counts binary, "
        "n_total bigint, v_total bigint, n_core bigint, v_core bigint"), "counts")
    n, v, n_core, v_core = (x or 0 for x in answers.filter("block = -1").agg(
        F.sum("n_total"), F.sum("v_total"), F.sum("n_core"), F.sum("v_core")).first())
    replies = answers.filter("block != -1").select("block", "held", "kind", "owner", "counts")
    told = "block bigint, ids array<bigint>, test array<boolean>, sizes binary, words binary, places binary"
    tuples = (rows.mapInArrow(_teller(True), told).groupBy("block")
              .cogroup(replies.filter("held").groupBy("block"))
              .applyInArrow(_tuples, "pair bigint, context bigint, word bigint, n bigint"))
    weights = learn_weights(tuples, n_core, v_core) if n else [[0.0, 0.0, 1.0]] * BUCKETS
    scored = (rows.mapInArrow(_teller(False), told).groupBy("block")
              .cogroup(replies.filter("NOT held").groupBy("block"))
              .applyInArrow(_scorer(weights, n, v), "id bigint, held_out boolean, n_tokens bigint, "
                            "n_known bigint, base_score double, score double"))
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known",
                         F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")
