import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL
from edge import table

from stackyard.llm import spelling
from stackyard.llm.queries import QUERIES
from stackyard.tables import load

LOWER = {i: i + 32 for i in range(65, 91)}


def model_words(rows, modulus=97, least=5):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % modulus == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 3}


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def model(rows, modulus=97):
    n = model_words(rows, modulus)
    by_gap = {}
    for w in n:   # words one apart share the word itself or a form with one position left out
        for key in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            by_gap.setdefault(key, set()).add(w)
    near = {w: set() for w in n}
    for group in by_gap.values():
        for a in group:
            near[a].update(b for b in group if b not in near[a] and one_apart(a, b))
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def rows_of(df):
    got = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_spelling_query_equals_brute_force(spark):
    rows = [tuple(r) for r in load(spark, SMALL, "documents").select("doc_id", "text").collect()]
    expected = model(rows)
    got = rows_of(QUERIES["op12_spelling"](spark, SMALL))
    assert got == expected
    assert any(r[1] for r in got) and any(r[2] != r[0] and r[2] != r[1] for r in got) and len(got) > 1000


def test_spelling_edge_rows(spark):
    words = ["hello", "hallo", "hxllo", "hell", "hellos", "helloo", "heello", "aaaaa", "aaaaaa", "aaaaaaa", "aaaab",
             "Àÿ×÷éx", "Àÿ×÷éy", "ab" * 40, "ab" * 40 + "a",
             "łabcdefg", "OTHER", "other", "o​ther"]
    rows = [(i, " ".join(w for j, w in enumerate(words) for _ in range(1 + (i * j) % 5))) for i in range(9)]
    rows += [(None, "hello\nhello-hello"), (3, None), (4, ""), (5, "\u0000hello퟿ world world"), (5, "world")]
    assert rows_of(spelling.spelling_variants(table(spark, rows), modulus=3)) == model(rows, 3)


def test_spelling_without_words(spark):
    for rows in ([], [(1, None), (2, ""), (3, "one two")]):
        got = spelling.spelling_variants(table(spark, rows))
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and got.count() == 0


def test_spelling_is_the_same_for_any_number_of_ranges(spark):
    rows = [(i, " ".join(f"stem{chr(97 + i % 26)}{chr(97 + j % 26)} stem common{chr(97 + j % 7)}" for j in range(60)))
            for i in range(80)]
    expected = model(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 3, 40):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            assert rows_of(spelling.spelling_variants(table(spark, rows))) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_nodes_are_one_for_each_prefix(spark):
    words = sorted({f"{a}{b}{c}" for a in ("ca", "car", "cart", "do") for b in ("", "x", "xy") for c in "abcdefgh"})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        df = spelling.saved(spark.createDataFrame([(w, 1) for w in words], "word string, n bigint"), "trie-test")
        rows = spelling.trie_paths(df, "trie-test").orderBy("wid").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r.word for r in rows] == words
    nodes = {}
    for r in rows:
        assert len(r.path) == len(r.word) + 1
        for i, node in enumerate(r.path):
            assert nodes.setdefault(r.word[:i], node) == node
    assert len(set(nodes.values())) == len(nodes)


def test_very_long_text_and_word(spark):
    long = "lettres " * 600_000
    rows = [(1, long), (2, "x" * 30_000 + " " + "x" * 30_001), (3, "x" * 30_000 + " " + "x" * 30_001),
            (4, "x" * 30_000 + " " + "x" * 30_001), (5, "lettre " * 3)]
    got = {(len(r.word), r.n_near) for r in spelling.spelling_variants(table(spark, rows), modulus=10**9 + 7).collect()}
    assert got == {(7, 1), (6, 1), (30_000, 1), (30_001, 1)}


@pytest.mark.parametrize("a,b,n", [("", "a", 0), ("abc", "abd", 2), ("abc", "abc", 3), ("y" * 200 + "a", "y" * 200 + "b", 200),
                                   ("z" * 100, "z" * 300, 100)])
def test_common_prefix(a, b, n):
    assert spelling.common_prefix(a, b) == n


def test_words_are_the_runs_of_the_pattern():
    text = "".join(map(chr, [*range(0x180), 0x200B, 0x1F600])) + "x" * 10
    whole = [w.decode("latin-1") for part in spelling.runs(text) for w in part]
    assert whole == [r.translate(LOWER) for r in re.findall("[A-Za-zÀ-ÿ]+", text)]


def test_group_of_letters_counts_without_pairs():
    # one pair of nodes: a whole word and three that skip the position, one inside a run of equal letters
    out = spelling.neighbours(np.zeros(4, np.int64), np.array([2, 0, 1, 2]), np.array([7, 3, 5, 9]), np.array([40, 30, 20, 10]))
    rows = sorted(zip(*(c.tolist() for c in out)))
    assert rows == sorted([(7, 2, 20, 5), (5, 2, 40, 7), (9, 2, 40, 7), (7, 1, 30, 3), (9, 1, 30, 3), (3, 2, 40, 7)])
