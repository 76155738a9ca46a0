"""Packing documents into sequences: large-item matching, then best fit.

Only the number of pieces of each length matters for a packing, and there are
no more lengths than the capacity.  So the plan is made on that histogram
(bounded by the capacity, whatever the input) and then dealt out to the rows:

1. each text is tokenized where it lies and cut into pieces of at most the
   capacity; only lengths and checksums (and the ids, if wanted) go on;
2. pieces above a third of the capacity are matched greedily, the largest with
   the largest that still fits, at most two to a sequence; the smaller ones,
   largest first, go to the tightest gap that takes them;
3. the plan is a list of runs, "pieces number r to r + k of length l go to
   sequences s to s + k at offset o", and each piece finds its run by its number
   among the pieces of its length.

The numbers come from counts per (length, chunk) plus a row number inside the
chunk, so a length that many documents share is spread over tasks.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackyard.llm.common import saved, shuffle_partitions, texts, worker_state
from stackyard.llm.words import slabs

CAPACITY = 2048
SEPARATOR = 0
CACHED_WORDS = 800_000
_SLAB_CHARS = 1 << 22
_TOGETHER = 1000   # words encoded in one call

#: A text with these is not lower-cased before the look-up (special strings, combining marks).
_AS_IS = re.compile("<\\||[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff]")


_PLAIN = re.compile("[!-~\u00c0-\u024f]+")   # printable ASCII and Latin letters


def _split_pattern(spec: dict):
    """The expression whose matches are the pre-tokens of a ``tokenizers`` file, or None."""
    import regex
    for step in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []):
        if step["type"] == "Split" and step["behavior"] == "Removed" and step["invert"] and "Regex" in step["pattern"]:
            return regex.compile(step["pattern"]["Regex"])
    return None


class WordIds:
    """Token ids of texts, word by word, for tokenizers that drop white space.

    Pre-tokens never span ASCII white space, so a text's ids are those of its
    words one after the other.  Words seen before come from a bounded cache; the
    library encodes the others, many to a call with a blank between them.  Their ids
    are cut apart again at the tokens that end a pre-token, which the
    vocabulary marks with a suffix: a word of letters is one pre-token, and of printable ASCII and
    Latin letters the file's own pattern says how many.  Other words are encoded one by one.
    """

    def __init__(self, path: str):
        import json

        import numpy as np
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.suffix = spec["model"].get("end_of_word_suffix")
        vocabulary = spec["model"]["vocab"]
        self.ends = np.zeros(1 + max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]), bool)
        if self.suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(self.suffix)]] = True
        self.pieces = _split_pattern(spec)

    def _parts(self, word: bytes) -> int:
        """Pre-tokens of a word, 0 if it must be encoded alone."""
        if not self.suffix:
            return 0
        text = word.decode()
        if text.isalpha():
            return int(text.lower().isalpha())
        lower = text.lower()
        if self.pieces is None or "<|" in text or len(lower) != len(text) or not _PLAIN.fullmatch(text):
            return 0
        return len(self.pieces.findall(lower))

    def _alone(self, words: list[bytes]) -> None:
        import numpy as np
        for i in range(0, len(words), 10_000):
            part = words[i:i + 10_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(
                    [w.decode() for w in part], add_special_tokens=False)):
                self.known[w] = np.array(e.ids, "<u4").tobytes()

    def _learn(self, new: list[bytes]) -> None:
        import numpy as np
        counted = [(w, n) for w in new if (n := self._parts(w))]
        self._alone([w for w in new if not self._parts(w)] if len(counted) < len(new) else [])
        for i in range(0, len(counted), _TOGETHER):
            words, counts = zip(*counted[i:i + _TOGETHER])
            got = self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids
            ids = np.array(got, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            last = np.cumsum(counts)
            if last[-1] != len(ends) or ends[-1] != len(ids):   # another notion of letters: no cutting
                self._alone(list(words))
                continue
            cuts, data = (4 * ends[last - 1]).tolist(), ids.tobytes()
            self.known.update(zip(words, [data[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]))

    def encode(self, batch: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [(t.encode() if _AS_IS.search(t) else t.encode().lower()).split() for t in batch]
        known = self.known
        new = list({w for words in split for w in words if w not in known})
        if len(known) + len(new) > CACHED_WORDS:
            # words met first are the frequent ones and stay; what this batch needs is learned again
            for w in list(known)[CACHED_WORDS // 2:]:
                del known[w]
            new = list({w for words in split for w in words if w not in known})
        self._learn(new)
        return [b"".join(map(known.__getitem__, words)) for words in split]


def _cutter(tokenizer: str, capacity: int, with_ids: bool):
    def run(batches):
        import pyarrow as pa
        words = worker_state(f"word_ids:{tokenizer}", lambda: WordIds(tokenizer))
        end = SEPARATOR.to_bytes(4, "little")
        for batch in batches:
            rid, key, text = (batch.column(c).to_pylist() for c in ("rid", "id", "text"))
            for lo, hi in slabs([len(t) for t in text], _SLAB_CHARS):
                out = []
                for r, k, ids in zip(rid[lo:hi], key[lo:hi], words.encode(text[lo:hi])):
                    ids += end
                    for start in range(0, len(ids), 4 * capacity):
                        piece = ids[start:start + 4 * capacity]
                        out.append((r, k, start // 4 // capacity, start // 4, len(piece) // 4,
                                    zlib.crc32(piece), piece if with_ids else None))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (
                    pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.record_batch(columns, names=["rid", "id", "piece", "start", "length",
                                                      "ids_crc32", "ids"])
    return run


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs ``(length, first number, count, first sequence, offset)`` for ``{length: pieces}``."""
    left = dict(histogram)
    numbered = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    sequences = 0

    def place(length: int, count: int, sequence: int, offset: int) -> None:
        runs.append((length, numbered[length], count, sequence, offset))
        numbered[length] += count
        left[length] -= count

    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        while left[a]:
            # the largest other piece that fits beside it; one piece is no pair with itself
            at = bisect_left(large, min(a, capacity - a) + 1) - 1
            while at >= 0 and (not left[large[at]] or large[at] == a and left[a] < 2):
                at -= 1
            b = large[at] if at >= 0 else 0
            count = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
            place(a, count, sequences, 0)
            if b:
                place(b, count, sequences, a)
            gaps[capacity - a - b].append((sequences, count))
            sequences += count
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        g = s
        while left[s] and g <= capacity:
            if not gaps[g]:
                g += 1
                continue
            first, count = gaps[g].pop()
            used = min(count, left[s])
            if used < count:
                gaps[g].append((first + used, count - used))
            place(s, used, first, capacity - g)
            gaps[g - s].append((first, used))
            g = max(s, g - s)
        fit = capacity // s
        for per, count in ((fit, left[s] // fit), (left[s] % fit, 1)):
            if per and count:
                for j in range(per):
                    place(s, count, sequences, j * s)
                gaps[capacity - per * s].append((sequences, count))
                sequences += count
    return runs


def _placer(runs: Iterable[tuple], top: int):
    import numpy as np
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        keys = table[:, 0] * top + table[:, 1]
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            at = np.searchsorted(keys, length * top + number, side="right") - 1
            sequence = table[at, 3] + number - table[at, 1]
            kept = [n for n in batch.schema.names if n != "number"]
            yield pa.record_batch([batch.column(n) for n in kept]
                                  + [pa.array(sequence), pa.array(table[at, 4])],
                                  names=kept + ["sequence_id", "offset"])
    return run


def _numbered(pieces: DataFrame, chunks: int) -> DataFrame:
    """``number``: the place of a piece among those of its length, from 0."""
    chunked = pieces.withColumn("chunk", F.pmod(F.xxhash64("rid", "piece"), F.lit(chunks)))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = saved(chunked.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "chunk-starts")
    inside = Window.partitionBy("length", "chunk").orderBy("rid", "piece")
    return (chunked.withColumn("row", F.row_number().over(inside)).join(starts.hint("merge"), ["length", "chunk"])
            .withColumn("number", F.col("first") + F.col("row") - 1).drop("chunk", "row", "first"))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its token ids and the separator id 0, so null and empty
    texts are one piece of length 1.  Only documents longer than ``capacity``
    are cut, into full pieces and a last one.  ``with_ids`` adds the ids of
    each piece (binary, little-endian unsigned 32 bit).  Null and repeated
    ids are kept as they are; every row is packed.  An empty table gives no
    rows.  ``tokenizer`` is the path of a ``tokenizers`` file whose
    pre-tokens do not span white space.
    """
    rows = texts(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("rid"), "id", "text")
    pieces = saved(rows.mapInArrow(
        _cutter(tokenizer, capacity, with_ids), "rid bigint, id bigint, piece int, start bigint, "
        "length bigint, ids_crc32 bigint, ids binary"), "pieces")
    if not with_ids:
        pieces = pieces.drop("ids")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    numbered = _numbered(pieces, shuffle_partitions(docs.sparkSession))
    top = 1 + max(histogram.values(), default=0)
    placed = numbered.mapInArrow(
        _placer(plan(histogram, capacity), top),
        ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema if f.name != "number")
        + ", sequence_id bigint, offset bigint")
    return placed.drop("rid").withColumnRenamed("id", id_col)
