"""Token counts with a whole-token shortcut.

Offline, once per vocabulary, every vocabulary string is merged from its bytes;
those that end up as a single token are proven to count 1 wherever they stand as a
pre-token.  Most pre-tokens of a text are such strings and are counted by
looking them up.  Only the rest are merged, all distinct ones of a slab of texts
together, each word's lowest-ranked pair per round.

Texts are counted where they lie, in slabs of bounded size; counts of chunks
already met come from a bounded cache.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackyard.llm.common import texts, worker_state
from stackyard.llm.pretokens import chunks
from stackyard.llm.vocabulary import NONE, Vocabulary, from_json
from stackyard.llm.words import slabs

LIMIT = 1024
CACHED_CHUNKS = 500_000
_SLAB_CHARS = 1 << 22
_MERGE_BYTES = 1 << 20


def merged_lengths(vocabulary: Vocabulary, words: list[bytes]) -> np.ndarray:
    """Tokens of each word after all merges.

    All words are merged together.  Each round joins, in every word, all
    places of its lowest-ranked pair, from left to right without overlap; words without a
    pair are done.
    """
    out = np.zeros(len(words), np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    tokens = vocabulary.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), lengths)
    while len(tokens):
        same = word[1:] == word[:-1]
        rank = np.full(len(tokens), NONE, np.int64)
        joined = np.full(len(tokens), -1, np.int64)
        found, into = vocabulary.lookup(tokens[:-1], tokens[1:])
        rank[:-1], joined[:-1] = np.where(same, found, NONE), into
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        least = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.append(starts, len(tokens)))
        done = least == NONE
        out[word[starts[done]]] = sizes[done]
        here = (rank == np.repeat(least, sizes)) & (rank != NONE)
        # in a run of overlapping pairs every other one merges, from its first
        at = np.flatnonzero(here)
        new_run = np.concatenate([[True], np.diff(at) > 1])[:len(at)]
        first = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - first) % 2 == 0]
        tokens[at] = joined[at]
        keep = np.repeat(~done, sizes)
        keep[at + 1] = False
        tokens, word = tokens[keep], word[keep]
    return out


def proven_whole(vocabulary: Vocabulary) -> frozenset[bytes]:
    """Vocabulary strings that encode alone as one token."""
    strings = list(vocabulary.tokens.values())
    return frozenset(s for s, n in zip(strings, merged_lengths(vocabulary, strings)) if n == 1)


class TokenCounter:
    """Counts tokens of texts for one ``tokenizers`` file."""

    def __init__(self, path: str, pattern: str):
        import regex
        self.vocabulary, special = from_json(path)
        self.whole = proven_whole(self.vocabulary)
        self.pattern = regex.compile(pattern)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.known: dict[str, int] = {}

    def _learn(self, new: list[str]) -> None:
        rest: dict[bytes, int] = {}
        found = []
        for chunk in new:
            count, odd = 0, []
            for p in self.pattern.findall(chunk):
                b = p.encode()
                if b in self.whole:
                    count += 1
                else:
                    odd.append(rest.setdefault(b, len(rest)))
            found.append((chunk, count, odd))
        words = list(rest)
        lengths: list[int] = []
        for lo, hi in slabs([len(w) for w in words], _MERGE_BYTES):
            lengths += merged_lengths(self.vocabulary, words[lo:hi]).tolist()
        for chunk, count, odd in found:
            self.known[chunk] = count + sum(lengths[i] for i in odd)

    def count(self, batch: list[str]) -> list[int]:
        parts, extra = [], []
        for t in batch:
            plain = [t]
            if self.special is not None and self.special.search(t):
                plain = self.special.split(t)
            parts.append([c for p in plain for c in chunks(p)])
            extra.append(len(plain) - 1)
        if len(self.known) > CACHED_CHUNKS:
            self.known.clear()
        known = self.known
        self._learn(list({c for cs in parts for c in cs if c not in known}))
        return [sum(map(known.__getitem__, cs)) + e for cs, e in zip(parts, extra)]


def _counter(path: str, pattern: str):
    def run(batches):
        import pyarrow as pa
        counter = worker_state(f"token_counter:{path}", lambda: TokenCounter(path, pattern))
        for batch in batches:
            text = batch.column("text").to_pylist()
            counts = []
            for lo, hi in slabs([len(t) for t in text], _SLAB_CHARS):
                counts += counter.count(text[lo:hi])
            yield pa.record_batch([batch.column("id"), batch.column("n_bytes"),
                                   pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])
    return run


def count_tokens(docs: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id",
                 text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per input row: ``id_col, n_bytes, n_tokens, over_limit``.

    ``tokenizer`` is a byte-level BPE file of ``tokenizers``, ``pattern`` its
    pre-token pattern.  Counts are the library's, without added special tokens;
    special strings inside a text are one token each.  Null and empty
    texts have none.  Ids, null or repeated, are carried along; an empty table
    gives no rows.
    """
    rows = texts(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    counted = rows.mapInArrow(_counter(tokenizer, pattern), "id bigint, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens",
                          (F.col("n_tokens") > limit).alias("over_limit"))
