"""Byte-level BPE encoding and decoding, by replaying the merges over all words.

The distinct pre-tokens of all texts are found and replayed once each:

1. every block of texts asks, once for each of its distinct words, the task that
   owns the word's hash range (words packed, one row per block and range), and
   sends its texts as word numbers, in the order asked, to where its answers will come;
2. the owner replays its distinct words and answers each block in the order asked;
3. a block's numbers meet its answers: numbers give ids, ids give the decoded bytes.

Questions and numbers leave in one shuffle, so texts are read and cut once and
never cross the network, and nothing that grows with the corpus is broadcast or
collected.  Should a lost executor make a task cut its texts again, it must read the same rows;
a block that does not find its answers fails the job.

In a replay the words are laid out in one array of tokens linked to their
neighbours.  An inverted index holds, for each merge, the positions where its
pair stands.  Merges are applied in rank order, each at all of its positions at
once; only the neighbours of a merged position are looked up again and enter
the index.

Joining a pair can, in rare words, bring up a pair of a lower rank than the
merge being applied.  Those words are merged again one step at a time, which
is the order the rank files define.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackyard.llm.common import shuffle_partitions, texts, worker_state
from stackyard.llm.pretokens import SPACES, chunks
from stackyard.llm.vocabulary import NONE, Vocabulary, from_ranks
from stackyard.llm.words import slabs

CACHED_CHUNKS = 300_000
BLOCK_CHARS = 1 << 24     # texts of one block, together
RANGE_BYTES = 1 << 28     # texts for which one more range of words is made
_SLAB_CHARS = 1 << 21     # texts whose chunks are held as lists
_REPLAY_BYTES = 1 << 22   # words that are replayed together
_STEP = 1 << 18


def _by_rank(ranks: np.ndarray, positions: np.ndarray):
    """``(rank, positions)`` for each rank that merges."""
    live = ranks != NONE
    ranks, positions = ranks[live], positions[live]
    if not len(ranks):
        return
    order = np.argsort(ranks, kind="stable")
    ranks, positions = ranks[order], positions[order]
    cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
    starts = [0, *cuts.tolist()]
    for a, b in zip(starts, [*starts[1:], len(ranks)]):
        yield int(ranks[a]), positions[a:b]


def _stepwise(vocabulary: Vocabulary, word: bytes) -> list[int]:
    """One word, its lowest-ranked pair (the first of equals) joined step by step."""
    tokens = vocabulary.of_byte[np.frombuffer(word, np.uint8)]
    while len(tokens) > 1:
        ranks, joined = vocabulary.lookup(tokens[:-1], tokens[1:])
        at = int(ranks.argmin())
        if ranks[at] == NONE:
            break
        tokens[at] = joined[at]
        tokens = np.delete(tokens, at + 1)
    return tokens.tolist()


def replay(vocabulary: Vocabulary, words: list[bytes]) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    n = int(bounds[-1])
    tokens = vocabulary.of_byte.astype(np.int32)[np.frombuffer(b"".join(words), np.uint8)]
    after = np.arange(1, n + 1, dtype=np.int32)
    before = np.arange(-1, n - 1, dtype=np.int32)
    after[bounds[1:] - 1] = -1
    before[bounds[:-1]] = -1
    rank = np.full(n, NONE, np.int32)   # of the pair that starts at a position
    gone = np.zeros(n, bool)
    inverted: list[int] = []

    def refresh(at: np.ndarray) -> np.ndarray:
        right = after[at]
        found, _ = vocabulary.lookup(tokens[at], tokens[right])
        rank[at] = found = np.where(right >= 0, found, NONE)
        return found

    index: dict[int, list[np.ndarray]] = {}
    waiting: list[int] = []

    def enter(ranks: np.ndarray, positions: np.ndarray) -> None:
        for r, at in _by_rank(ranks, positions):
            if r in index:
                index[r].append(at)
            else:
                index[r] = [at]
                heapq.heappush(waiting, r)

    for start in range(0, n, _STEP):
        refresh(np.arange(start, min(start + _STEP, n), dtype=np.int32))
    live = np.flatnonzero(rank != NONE).astype(np.int32)
    enter(rank[live], live)
    while waiting:
        now = heapq.heappop(waiting)
        at = np.unique(np.concatenate(index.pop(now)))
        at = at[(rank[at] == now) & ~gone[at]]
        if not len(at):
            continue
        # where pairs overlap, every other one is joined, from the first of the run
        runs = np.concatenate([[True], after[at[:-1]] != at[1:]])
        if not runs.all():
            first = np.maximum.accumulate(np.where(runs, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
        right = after[at]
        beyond = after[right]
        _, tokens[at] = vocabulary.lookup(tokens[at], tokens[right])
        gone[right] = True
        after[at] = beyond
        linked = beyond >= 0
        before[beyond[linked]] = at[linked]
        left = before[at]
        touched = np.unique(np.concatenate([at, left[left >= 0]]))
        found = refresh(touched)
        lower = found < now
        if lower.any():
            inverted.extend(touched[lower].tolist())
        enter(found, touched)
    kept = np.concatenate([[0], np.cumsum(~gone)])[bounds].tolist()
    flat = tokens[~gone].astype("<u4").tobytes()
    out = [flat[4 * a:4 * b] for a, b in zip(kept[:-1], kept[1:])]
    for w in {int(np.searchsorted(bounds, p, side="right")) - 1 for p in inverted}:
        out[w] = np.array(_stepwise(vocabulary, words[w]), "<u4").tobytes()
    return out


class Codec:
    """Encodes texts and decodes ids for one rank file."""

    def __init__(self, path: str, pattern: str):
        import regex
        self.vocabulary = from_ranks(path)
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def cut(self, new: Iterable[str], regular: Iterable[str] = (),
            number: dict[str, int] | None = None) -> tuple[dict[str, int], list[tuple[str, list[int]]]]:
        """The words of some chunks numbered (on top of those in ``number``), and for each chunk the
        numbers of its words.

        ``regular`` chunks are of texts that were cut at white space; those that begin
        with it and do not end with it keep their words when they stand in a row.
        """
        number = {} if number is None else number
        rest, row = list(new), []
        for c in regular:
            (row if c[0] in SPACES and c[-1] not in SPACES else rest).append(c)
        found = [(c, [number.setdefault(p, len(number)) for p in self.pattern.findall(c)]) for c in rest]
        for lo, hi in slabs([len(c) for c in row], _SLAB_CHARS):
            parts = self.pattern.findall("".join(row[lo:hi]))
            at = [number.setdefault(p, len(number)) for p in parts]
            ends = np.cumsum(np.fromiter(map(len, row[lo:hi]), np.int64, hi - lo))
            cuts = np.searchsorted(np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))), ends) + 1
            cuts = [0, *cuts.tolist()]
            found += zip(row[lo:hi], [at[x:y] for x, y in zip(cuts[:-1], cuts[1:])])
        return number, found

    def numbered(self, text: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The distinct words of a block, the word numbers of all its texts, and how many each text has."""
        number: dict[str, int] = {}
        known: dict[str, bytes] = {}
        flat, sizes = [], []
        for lo, hi in slabs([len(t) for t in text], _SLAB_CHARS):
            found = [chunks(t) for t in text[lo:hi]]
            whole = {c for cs in found if len(cs) == 1 for c in cs if c not in known}
            regular = {c for cs in found if len(cs) > 1 for c in cs if c not in known}
            for c, parts in self.cut(whole, regular, number)[1]:
                known[c] = np.array(parts, "<u4").tobytes()
            joined = [b"".join(map(known.__getitem__, cs)) for cs in found]
            sizes += [len(j) // 4 for j in joined]
            flat.append(b"".join(joined))
        return [w.encode() for w in number], np.frombuffer(b"".join(flat), "<u4"), np.array(sizes, "<u4")

    def replayed(self, words: list[bytes]) -> list[bytes]:
        ids = []
        for lo, hi in slabs([len(w) for w in words], _REPLAY_BYTES):
            ids += replay(self.vocabulary, words[lo:hi])
        return ids

    def _learn(self, new: list[str]) -> None:
        number, found = self.cut(new)
        ids = self.replayed([w.encode() for w in number])
        for c, parts in found:
            self.known[c] = b"".join([ids[i] for i in parts])

    def learn(self, batch: list[str]) -> None:
        """Ids of all chunks of the texts, so that ``encode`` looks them up."""
        if len(self.known) > CACHED_CHUNKS:
            self.known.clear()
        known, new = self.known, set()
        for lo, hi in slabs([len(t) for t in batch], _SLAB_CHARS):
            for t in batch[lo:hi]:
                new.update([c for c in chunks(t) if c not in known])
        self._learn(list(new))

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text that was learned."""
        return b"".join(map(self.known.__getitem__, chunks(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _codec(path: str, pattern: str) -> Codec:
    return worker_state(f"bpe_codec:{path}:{pattern}", lambda: Codec(path, pattern))


def _blocks(batches):
    """``(block id, ids, texts)`` of blocks of bounded size, the same on every reading."""
    import xxhash
    from pyspark import TaskContext
    task, number = TaskContext.get().partitionId(), 0
    ids, text, size = [], [], 0

    def block():
        name = f"{task} {number} {ids} {[len(t) for t in text]}"
        return xxhash.xxh3_64_intdigest(name.encode()) >> 1, ids, text

    for batch in batches:
        for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            if text and size + len(t) > BLOCK_CHARS:
                yield block()
                ids, text, size, number = [], [], 0, number + 1
            ids.append(i)
            text.append(t)
            size += len(t)
    if text:
        yield block()


def _in_order(words: list[bytes]) -> tuple[list[int], np.ndarray]:
    """Hashes of the words, and their numbers, in the order in which a block asks."""
    import xxhash
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    order = np.argsort(hashes)
    if (hashes[order][1:] == hashes[order][:-1]).any():   # equal hashes go by word
        order = np.array(sorted(range(len(words)), key=lambda i: (int(hashes[i]), words[i])), np.int64)
    return hashes[order].tolist(), order


def _packed(items: list[bytes]) -> bytes:
    import zstandard as zs
    sizes = np.fromiter(map(len, items), "<u4", len(items)).tobytes()
    return zs.ZstdCompressor().compress(np.array(len(items), "<u4").tobytes() + sizes + b"".join(items))


def _unpacked(packed: bytes) -> list[bytes]:
    import zstandard as zs
    data = zs.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64)).tolist()
    return [data[a:b] for a, b in zip([4 + 4 * n, *ends[:-1]], ends)]


def _planes(a: np.ndarray) -> bytes:
    """32-bit numbers, byte plane by byte plane, compressed."""
    import zstandard as zs
    return zs.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, 4).T.tobytes())


def _from_planes(packed: bytes) -> np.ndarray:
    import zstandard as zs
    raw = np.frombuffer(zs.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


_SENT = "to bigint, block bigint, words binary, rows array<bigint>, sizes binary, numbers binary"


def _asker(path: str, pattern: str, ranges: int):
    """A block's questions, one row per owner, and its texts as numbers, for the block itself.

    ``to`` is below 0 for an owner and the block otherwise.
    """
    def run(batches):
        from itertools import groupby

        import pyarrow as pa
        codec = _codec(path, pattern)
        for block, ids, text in _blocks(batches):
            words, flat, sizes = codec.numbered(text)
            del text
            hashes, order = _in_order(words)
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            order = order.tolist()
            out = [(-1 - owner, block, _packed([words[i] for _, i in asked]), None, None, None) for owner, asked in
                   groupby(zip(hashes, order), lambda x: x[0] * ranges >> 64)]
            out.append((block, block, None, ids, _planes(sizes), _planes(place[flat]) if len(words) else b""))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                  names=["to", "block", "words", "rows", "sizes", "numbers"])
    return run


def _answerer(path: str, pattern: str):
    """Replays the distinct words of one range, and answers each block in the order asked."""
    def run(table):
        import pyarrow as pa
        to = table.column("to")[0].as_py()
        blocks, asked = [], []
        if to < 0:   # numbers are not for an owner
            number: dict[bytes, int] = {}
            for block, words in zip(table.column("block").to_pylist(), table.column("words")):
                blocks.append(block)
                asked.append([number.setdefault(w, len(number)) for w in _unpacked(words.as_py())])
            ids = _codec(path, pattern).replayed(list(number))
        return pa.table({"owner": pa.array([-1 - to] * len(blocks), pa.int32()), "block": pa.array(blocks, pa.int64()),
                         "ids": pa.array([_packed([ids[i] for i in places]) for places in asked], pa.binary())})
    return run


def _meeter(path: str, pattern: str, decoding: bool):
    """A block's numbers looked up in its answers."""
    def run(told, answers):
        import pyarrow as pa
        codec = _codec(path, pattern)
        names = ["id", "ids", *["decoded"] * decoding]
        if told.num_rows and told.column("to")[0].as_py() < 0:   # questions are not for a block
            return pa.table({n: pa.array([], pa.int64() if n == "id" else pa.binary()) for n in names})
        if told.num_rows != 1:
            raise RuntimeError("a block's texts were not the same when they were cut again")
        given: list[bytes] = []
        for a in sorted(answers.to_pylist(), key=lambda a: a["owner"]):
            given += _unpacked(a["ids"])
        rows, sizes = told.column("rows")[0].as_py(), _from_planes(told.column("sizes")[0].as_py())
        packed = told.column("numbers")[0].as_py()
        numbers = _from_planes(packed) if packed else np.zeros(0, np.uint32)
        if len(numbers) and int(numbers.max()) + 1 != len(given):
            raise RuntimeError("a block's texts were not the same when they were cut again")
        ends = np.cumsum(sizes, dtype=np.int64).tolist()
        read = [codec.decode(x) for x in given] if decoding else []
        out, plain = [], []
        for a, b in zip([0, *ends[:-1]], ends):
            at = numbers[a:b].tolist()
            out.append(b"".join([given[i] for i in at]))
            if decoding:
                plain.append(b"".join([read[i] for i in at]))
        columns = [pa.array(rows, pa.int64()), pa.array(out, pa.binary()), *([pa.array(plain, pa.binary())] if decoding else [])]
        return pa.table(dict(zip(names, columns)))
    return run


def _decoder(path: str, pattern: str):
    def run(batches):
        import pyarrow as pa
        codec = _codec(path, pattern)
        for batch in batches:
            source = batch.column("ids").to_pylist()
            for lo, hi in slabs([len(x) for x in source], _SLAB_CHARS):
                yield pa.record_batch(
                    [batch.column("id").slice(lo, hi - lo), pa.array(source[lo:hi], pa.binary()),
                     pa.array([codec.decode(x) for x in source[lo:hi]], pa.binary())], names=["id", "ids", "decoded"])
    return run


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``(id_col, ids)``: token ids of each text, as little-endian unsigned 32-bit integers.

    ``ranks`` is a file of base64 tokens and ranks, ``pattern`` what cuts texts
    before the merges.  Special strings are ordinary text.  Null and empty texts
    have no ids.  Row ids, null or repeated, are carried along; an empty
    table gives no rows.  ``decoded`` adds the bytes that the ids decode to,
    in the same pass.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    ranges = max(shuffle_partitions(spark), math.ceil(size / RANGE_BYTES))
    # both uses of ``sent`` read one shuffle
    sent = rows.mapInArrow(_asker(ranks, pattern, ranges), _SENT).groupBy("to")
    answers = sent.applyInArrow(_answerer(ranks, pattern), "owner int, block bigint, ids binary")
    met = sent.cogroup(answers.groupBy("block")).applyInArrow(
        _meeter(ranks, pattern, decoded), "id bigint, ids binary" + ", decoded binary" * decoded)
    return met.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """``(id_col, ids, decoded)``: the bytes that the ids of ``encode`` stand for (null ids: none)."""
    ids = F.coalesce(F.col("ids"), F.lit(b""))
    return encoded.select(F.col(f"`{id_col}`").alias("id"), ids.alias("ids")).mapInArrow(
        _decoder(ranks, pattern),
        "id bigint, ids binary, decoded binary").withColumnRenamed("id", id_col)
