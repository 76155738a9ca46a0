"""Spelling variants: words one code point apart, found through pairs of trie nodes.

The vocabulary is numbered twice: each distinct prefix is a node of a forward
trie, each distinct suffix a node of a reversed one.  A word of length L stands
in the dictionary under the pairs (prefix of i, suffix from i) for i in 0..L,
which only it can have, and under the pairs (prefix of i, suffix from i + 1) that
skip position i.  Two words that share a skipping pair differ by one replaced
code point; a word whose own pair is a skipping pair of another is that word
with one code point deleted.  Of a run of equal letters only the first may be
deleted for this, so each pair of words is met exactly once.  No candidate needs
a check of the texts, and no distance is computed.

A pair of nodes fixes all but one code point, so at most the letters of the
alphabet (here 90) and one whole word stand under it, however common a word
is; a group gives each of its members a count and its best neighbour, not
pairs of words.

The tries are built from the sorted vocabulary, cut into ranges: along a
sorted list a word adds the nodes beyond its common prefix with the word
before.  A range numbers its own nodes; those that its words share with earlier
ranges are on the path of the last word before it, and are put right from
one path per range (the only data that reach the driver: one word per range).

Null texts hold no words; a null id counts as the empty text in the hash.  Rows
of one id are counted each on their own.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackyard.llm.common import saved, shuffle_partitions, texts

SLAB = 1 << 20           # characters of a text cut into words at a time
HELD_WORDS = 100_000     # distinct words counted before they are handed on
HELD_BYTES = 4 << 20
OUT_ROWS = 200_000
_RANGE_BITS = 40

#: Latin-1 code points: A-Z lower-cased, a-z and 0xC0-0xFF kept, everything else a blank.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str):
    """Lower-cased runs of letters, a slab at a time, as lists of Latin-1 bytes."""
    start = 0
    raw = text.encode("latin-1", "replace").translate(_TABLE)   # other characters become one '?' each
    while start < len(raw):
        end = raw.find(b" ", start + SLAB)
        end = len(raw) if end < 0 else end
        yield raw[start:end].split()
        start = end


def misspelt(word: bytes, key: int, modulus: int) -> bytes:
    """``word`` without one code point where the hash ``key`` says so."""
    if key % modulus:
        return word
    at = key % len(word)
    return word[:at] + word[at + 1:]


def _counted(least: int, modulus: int):
    def out(counts):
        import pyarrow as pa
        return pa.record_batch([pa.array([w.decode("latin-1") for w in counts], pa.string()),
                                pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        counts: Counter = Counter()
        size = 0
        for batch in batches:
            for key, text in zip(batch.column("id"), batch.column("text")):
                key, text = key.as_py(), text.as_py()
                seed = zlib.crc32(f"{'' if key is None else key}:".encode())
                for words in runs(text):
                    for w, n in Counter(words).items():
                        if len(w) < least:
                            continue
                        utf8 = w if w.isascii() else w.decode("latin-1").encode()
                        w = misspelt(w, zlib.crc32(utf8, seed), modulus)
                        if len(w) >= least:
                            if w not in counts:
                                size += len(w)
                            counts[w] += n
                    if len(counts) > HELD_WORDS or size > HELD_BYTES:
                        yield out(counts)
                        counts.clear()
                        size = 0
        yield out(counts)
    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5,
               least_count: int = 3, modulus: int = 97) -> DataFrame:
    """``(word, n)``: the words of all texts with their occurrences, counted in the tasks first."""
    counted = texts(docs, id_col, text_col).mapInArrow(_counted(least_length, modulus), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def common_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if n <= 64:
        for i in range(n):
            if a[i] != b[i]:
                return i
        return n
    low, high = 0, n   # long words: halve the open part
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _numbered(batches):
    """Sorted words of one range: ordinal, nodes along the word, and how much it shares with the first word."""
    import pyarrow as pa
    from pyspark import TaskContext
    base = TaskContext.get().partitionId()
    first_id, made, ordinal = base << _RANGE_BITS, 0, 0
    before, path, shared = None, [-1], 0

    def out(words, counts, share, flat, ends):
        m = len(words)
        return pa.record_batch(
            [pa.array([base] * m, pa.int32()), pa.array(range(first_id + ordinal - m, first_id + ordinal), pa.int64()),
             pa.array(words, pa.string()), pa.array(counts, pa.int64()), pa.array(share, pa.int32()),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))],
            names=["part", "wid", "word", "n", "shared", "path"])

    words, counts, share, flat, ends = [], [], [], [], [0]
    for batch in batches:
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
            k = 0 if before is None else common_prefix(before, word)
            shared = len(word) if before is None else min(shared, k)
            new = len(word) - k
            path = path[:k + 1] + list(range(first_id + made, first_id + made + new))
            made, ordinal, before = made + new, ordinal + 1, word
            words.append(word), counts.append(n), share.append(shared), flat.extend(path), ends.append(len(flat))
            if len(flat) > OUT_ROWS:
                yield out(words, counts, share, flat, ends)
                words, counts, share, flat, ends = [], [], [], [], [0]
    if words:
        yield out(words, counts, share, flat, ends)


def inherited(ends: list[tuple[int, str, str, int, list[int]]]) -> list[tuple[int, list[int]]]:
    """Per range, the true nodes of the part of its first word that earlier ranges hold.

    ``ends``: per range in order its number, first and last word, what the last
    shares with the first, and the last word's own nodes.
    """
    out, before, path = [], "", [-1]
    for part, first, last, shared, own in ends:
        held = path[:common_prefix(before, first) + 1]
        out.append((part, held))
        depth = min(len(held), shared + 1)
        before, path = last, held[:depth] + list(own[depth:])
    return out


def trie_paths(words: DataFrame, label: str) -> DataFrame:
    """``(wid, word, n, path)`` of a table of distinct words ``(word, n)``.

    ``path[i]`` is the number of the prefix of length ``i``, the same for all
    words that begin with it.  ``wid`` numbers the words in code-point order.
    """
    spark = words.sparkSession
    sort = words.repartitionByRange(shuffle_partitions(spark), "word").sortWithinPartitions("word")
    own = saved(sort.mapInArrow(_numbered, "part int, wid bigint, word string, n bigint, shared int, path array<bigint>"),
                label)
    ends = own.groupBy("part").agg(F.min_by("word", "wid"), F.max_by("word", "wid"), F.max_by("shared", "wid"),
                                   F.max_by("path", "wid")).collect()
    fixes = spark.createDataFrame(inherited(sorted((tuple(r) for r in ends), key=lambda r: r[0])),
                                  "part int, held array<bigint>")
    depth = F.least(F.size("held"), F.col("shared") + 1)
    whole = F.concat(F.slice("held", F.lit(1), depth), F.slice("path", depth + 1, F.size("path") - depth))
    return own.join(fixes, "part").select("wid", "word", "n", whole.alias("path"))


def _paired(batches):
    """Each word under its own pairs of nodes (kind 0) and its skipping pairs (2; 1 inside a run of equal letters)."""
    import pyarrow as pa

    def out(held):
        p, s, w, n, k = (np.concatenate(c) for c in zip(*held))
        for i in range(0, len(p), OUT_ROWS):
            yield pa.record_batch([pa.array(c[i:i + OUT_ROWS]) for c in (p, s, w, n, k)],
                                  names=["prefix", "suffix", "wid", "n", "kind"])

    held, size = [], 0
    for batch in batches:
        for word, wid, n, f, r in zip(*(batch.column(c) for c in ("word", "wid", "n", "path", "back"))):
            f, r, word = f.values.to_numpy(), r.values.to_numpy()[::-1], word.as_py()
            letters = np.frombuffer(word.encode("latin-1"), np.uint8)   # one byte a code point
            kinds = np.zeros(len(f) + len(letters), np.int8)
            kinds[len(f):] = 2
            kinds[len(f) + 1:][letters[1:] == letters[:-1]] = 1
            m = len(kinds)
            held.append((np.concatenate([f, f[:-1]]), np.concatenate([r, r[1:]]), np.full(m, wid.as_py()),
                         np.full(m, n.as_py()), kinds))
            size += m
            if size > OUT_ROWS:
                yield from out(held)
                held, size = [], 0
    if held:
        yield from out(held)


def neighbours(group: np.ndarray, kind: np.ndarray, wid: np.ndarray, n: np.ndarray) -> tuple:
    """``(wid, near words, n of the best, wid of the best)`` from the members of whole groups.

    Members are ordered by group, then best first (largest ``n``, then smallest ``wid``).
    """
    groups = int(group[-1]) + 1 if len(group) else 0

    def firsts(rows):
        """Of each group: how many of ``rows``, and the first and second of them."""
        count = np.bincount(group[rows], minlength=groups)
        start = np.concatenate([[0], np.cumsum(count)[:-1]])
        padded = np.concatenate([rows, [0, 0]])
        return count, padded[start], padded[start + 1]

    whole, skips, deleted = (np.flatnonzero(m) for m in (kind == 0, kind > 0, kind == 2))
    has_whole, whole_of, _ = firsts(whole)
    n_skips, best, second = firsts(skips)
    n_deleted, best_deleted, _ = firsts(deleted)
    parts = []
    rows = skips[n_skips[group[skips]] > 1]                     # one replaced
    other = np.where(best[group[rows]] == rows, second[group[rows]], best[group[rows]])
    parts.append((rows, n_skips[group[rows]] - 1, other))
    rows = deleted[has_whole[group[deleted]] > 0]               # the word with one deleted
    parts.append((rows, np.ones(len(rows), np.int64), whole_of[group[rows]]))
    rows = whole[n_deleted[group[whole]] > 0]                   # words with one more
    parts.append((rows, n_deleted[group[rows]], best_deleted[group[rows]]))
    rows, counts, others = (np.concatenate(c) for c in zip(*parts))
    return wid[rows], counts, n[others], wid[others]


def _matched(batches):
    """Rows sorted by pair of nodes, best first, to the neighbours of whole groups."""
    import pyarrow as pa
    tail = None
    names = ("prefix", "suffix", "kind", "wid", "n")

    def done(cols):
        p, s, kind, wid, n = cols
        change = np.concatenate([[False], (p[1:] != p[:-1]) | (s[1:] != s[:-1])])
        out = neighbours(np.cumsum(change), kind, wid, n)
        return pa.record_batch([pa.array(c.astype(np.int64)) for c in out], names=["wid", "near", "best_n", "best"])

    for batch in batches:
        cols = [batch.column(c).to_numpy() for c in names]
        if tail is not None:
            cols = [np.concatenate(c) for c in zip(tail, cols)]
        p, s = cols[:2]
        if not len(p):
            continue
        last = np.flatnonzero((p != p[-1]) | (s != s[-1]))       # the last group may go on in the next batch
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield done([c[:cut] for c in cols])
        tail = [c[cut:].copy() for c in cols]
    if tail is not None and len(tail[0]):
        yield done(tail)


def near_words(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(numbered, near)`` of a written table of distinct ``(word, n)``: ``numbered`` is
    ``(wid, word, n)``, ``near`` is ``(wid, n_near, best_n, best)`` of the words that have a near word."""
    forward = saved(trie_paths(words, "spell-nodes"), "spell-forward")
    backward = trie_paths(words.select(F.reverse("word").alias("word"), "n"), "spell-back-nodes").select(
        F.reverse("word").alias("b_word"), F.col("path").alias("back"))
    pairs = forward.join(backward, F.col("word") == F.col("b_word")).mapInArrow(
        _paired, "prefix bigint, suffix bigint, wid bigint, n bigint, kind tinyint")
    # at most 91 rows a pair of nodes
    met = (pairs.repartition("prefix", "suffix")
           .sortWithinPartitions("prefix", "suffix", F.desc("n"), "wid")
           .mapInArrow(_matched, "wid bigint, near bigint, best_n bigint, best bigint"))
    near = met.groupBy("wid").agg(F.sum("near").alias("n_near"),
                                  F.max(F.struct("best_n", (-F.col("best")).alias("least"))).alias("m"))
    return (forward.select("wid", "word", "n"),
            near.select("wid", "n_near", F.col("m.best_n").alias("best_n"), (-F.col("m.least")).alias("best")))


def roots(forms: DataFrame, largest: int, ratio: int = 2) -> DataFrame:
    """``(wid, root)`` of ``(wid, form)`` where each form is at least ``ratio`` times as frequent.

    Pointers are doubled as often as the longest chain up to the frequency ``largest`` can need.
    """
    steps, top = 0, max(largest, 1)
    while top >= ratio:
        steps, top = steps + 1, top // ratio
    at = forms.select("wid", F.col("form").alias("root"))
    done = 1
    while done < steps:
        at = saved(at.alias("a").join(at.alias("b"), F.expr("a.root = b.wid"), "left").select(
            "a.wid", F.coalesce("b.root", "a.root").alias("root")), "spell-roots")
        done *= 2
    return at


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5,
                      least_count: int = 3, modulus: int = 97, ratio: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the texts.

    ``form`` is the near word of largest ``n`` (of equal ones the first in
    code-point order) if that is at least ``ratio`` times the word's; ``root``
    is where following forms ends.  Words without a near word have ``n_near`` 0.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2: forms must grow along a chain")
    words = saved(vocabulary(docs, id_col, text_col, least_length, least_count, modulus), "spell-words")
    numbered, near = near_words(words)
    takes = F.col("best_n") >= ratio * F.col("n")
    all_words = saved(numbered.join(near, "wid", "left").select(
        "wid", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n")), "spell-forms")
    largest = words.agg(F.max("n")).first()[0] or 0
    ends = roots(all_words.where("form IS NOT NULL"), largest, ratio)
    names = all_words.select(F.col("wid").alias("k"), F.col("word").alias("v"))
    out = all_words.join(ends, "wid", "left")
    for col in ("form", "root"):
        named = names.select(F.col("k").alias(f"{col}_id"), F.col("v").alias(f"{col}_word"))
        out = out.join(named, F.col(col) == F.col(f"{col}_id"), "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"),
                      "n", "n_near", "form_n")
