import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from edge import ROWS, table
from tokenizers import Tokenizer

from stackyard.llm import bestfit_packing as packing
from stackyard.llm import bpe_codec, token_counts
from stackyard.llm.pretokens import chunks
from stackyard.llm.queries import QUERIES
from conftest import SMALL

PIECES = [*"aabcAB  \n\t'sé0129.,!?-", "'re", "'ll", " ", " ", "ß", "日本", "😀", "\x1c", "<|endoftext|>",
          "<|startoftext|>", "<|StartOfText|>", "<|", "the", " and", "aaaaaaaa", "\r\n", "   ", "H̱", "İ", "̇"]


def strings(n, seed=4):
    rng = random.Random(seed)
    out = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(60))) for _ in range(n)]
    return out + ["", "a" * 3000, "ab" * 2000, " " * 1000, *[t or "" for _, t in ROWS]]


def reference_encoding(name):
    with open(P.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_codec_equals_the_library(name):
    codec = bpe_codec.Codec(P.path(name), P.PATTERN)
    texts = strings(3000)
    codec.learn(texts)
    ids = [codec.encode(t) for t in texts]
    library = reference_encoding(name)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [library.encode_ordinary(t) for t in texts]
    assert [codec.decode(x) for x in ids] == [t.encode() for t in texts]


def test_replay_handles_pairs_of_lower_rank():
    # "bc" is joined before "abc" is in reach, and "abc" then has a lower rank than "bc"
    tokens = {b"a": 0, b"b": 1, b"c": 2, b"x": 3, b"xa": 4, b"ab": 5, b"abc": 6, b"bc": 7, b"xabc": 8}
    merges = [(tokens[t[:i]], tokens[t[i:]], r, r) for t, r in tokens.items() for i in range(1, len(t))
              if t[:i] in tokens and t[i:] in tokens]
    v = bpe_codec.Vocabulary({r: t for t, r in tokens.items()}, merges)
    rng = random.Random(1)
    words = ["".join(rng.choice("abcx") for _ in range(rng.randrange(1, 12))).encode() for _ in range(500)]
    expected = [np.array(bpe_codec._stepwise(v, w), "<u4").tobytes() for w in words]
    assert bpe_codec.replay(v, words) == expected


def test_codec_query_against_the_library(spark):
    library = reference_encoding("byte_bpe_50k.tiktoken")
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = QUERIES["op7_bpe_codec"](spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = np.array(library.encode_ordinary(docs[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_codec_of_awkward_rows(spark):
    args = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    got = bpe_codec.decode(bpe_codec.encode(table(spark), *args), *args).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in got) == sorted(
        (str(i), t or "") for i, t in ROWS)
    assert bpe_codec.encode(table(spark, []), *args).collect() == []


def test_a_word_is_replayed_once_in_the_whole_table(spark, monkeypatch, tmp_path):
    log = str(tmp_path / "words")
    replay = bpe_codec.replay

    def logged(vocabulary, words):
        with open(log, "a") as f:
            f.write("".join(w.hex() + "\n" for w in words))
        return replay(vocabulary, words)

    monkeypatch.setattr(bpe_codec, "replay", logged)
    docs = [(i, f"the same words {i % 7} and more of the same {i % 5}") for i in range(400)]
    got = bpe_codec.encode(table(spark, docs).repartition(6), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    library = reference_encoding("byte_bpe_50k.tiktoken")
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got} == {
        i: library.encode_ordinary(t) for i, t in docs}
    with open(log) as f:
        seen = f.read().split()
    assert len(seen) == len(set(seen)) > 10


def test_chunks_cut_where_pre_tokens_end():
    import regex
    pattern = regex.compile(P.PATTERN)
    for t in strings(3000, seed=8):
        assert [p for c in chunks(t) for p in pattern.findall(c)] == pattern.findall(t)


def test_token_counts_equal_the_library():
    counter = token_counts.TokenCounter(P.path("byte_bpe_50k.json"), P.PATTERN)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = strings(3000, seed=9)
    assert counter.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_proven_whole_strings_are_single_tokens():
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    vocabulary, _ = token_counts.from_json(P.path("byte_bpe_50k.json"))
    whole = token_counts.proven_whole(vocabulary)
    readable = [s.decode() for s in sorted(whole) if s.isascii() and s.isalpha()][::50]
    assert all(len(library.encode(s, add_special_tokens=False).ids) == 1 for s in readable)


def test_token_count_query_and_awkward_rows(spark):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in QUERIES["op9_token_counts"](spark, SMALL).collect():
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 1024)
    args = P.path("byte_bpe_50k.json"), P.PATTERN
    got = token_counts.count_tokens(table(spark), *args).collect()
    assert len(got) == len(ROWS)
    assert all(r.n_tokens == 0 and not r.over_limit for r in got if r.n_bytes == 0)
    assert token_counts.count_tokens(table(spark, []), *args).collect() == []


def check_packing(rows, texts, capacity):
    """Every piece is right and every sequence is filled from 0 without gaps."""
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    expected = []
    for key, t in texts:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        expected += [(str(key), i, a, len(ids[a:a + capacity]), zlib.crc32(ids[a:a + capacity].tobytes()))
                     for i, a in enumerate(range(0, len(ids), capacity))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values(), default=0) <= capacity
    return len(ends), sum(r.length for r in rows)


def test_packing_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    used, total = check_packing(QUERIES["op5_bestfit_packing"](spark, SMALL).collect(), docs, 2048)
    assert used <= 1.03 * -(-total // 2048)


@pytest.mark.parametrize("capacity", [1, 7, 64])
def test_packing_of_awkward_rows(spark, capacity):
    path = P.path("word_bpe_49k.json")
    check_packing(packing.pack(table(spark), path, capacity=capacity).collect(), ROWS, capacity)
    assert packing.pack(table(spark, []), path).collect() == []


def test_packing_with_ids(spark):
    got = packing.pack(table(spark), P.path("word_bpe_49k.json"), with_ids=True).collect()
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)


def test_word_ids_equal_the_library():
    words = packing.WordIds(P.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = strings(3000, seed=10)
    assert [np.frombuffer(x, "<u4").tolist() for x in words.encode(texts)] == [
        library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("seed", range(5))
def test_plans_are_whole_and_near_the_bound(seed):
    rng = random.Random(seed)
    capacity = 100
    histogram = {n: rng.randrange(1, 40) for n in rng.sample(range(1, capacity + 1), 30)}
    runs = packing.plan(histogram, capacity)
    bins, numbers = {}, {}
    for length, first, count, sequence, offset in runs:
        for k in range(count):
            numbers.setdefault(length, set()).add(first + k)
            bins.setdefault(sequence + k, []).append((offset, length))
    assert {n: set(range(c)) for n, c in histogram.items()} == numbers
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity and sum(3 * n > capacity for _, n in pieces) <= 2
    large = sum(c for n, c in histogram.items() if 2 * n > capacity)
    bound = max(large, -(-sum(n * c for n, c in histogram.items()) // capacity))
    assert len(bins) <= 1.15 * bound + 1
