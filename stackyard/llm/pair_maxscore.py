"""Ranked lexical search: MaxScore over blocks of documents, with bounds for pairs of terms.

``build_index`` cuts the documents into blocks of about ``BLOCK_BYTES`` of text,
one row per block: the sorted terms, and per term the documents and occurrences.
``prepared`` adds what a set of items needs: per block and term the scores of its
documents and the largest, and for pairs of terms of one item the documents
that hold both (the intersection list) and the largest joint score among them.
Both are written tables.  ``search`` runs all items against all blocks.

A document takes from a pair of terms at most the largest of the two single
maxima and the joint maximum, often less than the sum of the two: rare
partners may never meet, and a document good for one is seldom as good for the
other.  An item's terms are paired by weight, each term in one pair; the sum
of the pair bounds over an item bounds every document of the block.  A block
whose bound is below the item's 50th best score so far is skipped whole.  In
other blocks the pairs of small bounds, together below that score, select no
candidates; they are only added to documents that the others found, largest bound
first, and the intersection list says which of those may gain the joint maximum
and which a single one.  Scores equal to the threshold are never skipped, so ties
are right.  Thresholds grow over the blocks of a task; each task gives its best per item.

Terms are maximal runs of ASCII letters and digits and of all characters from
U+0080 on, A-Z lower-cased.  Null texts have none.  Rows of one ``item_id`` are
one item with the terms of all of them; rows of one ``doc_id`` are ranked each.
Null document ids rank after others of the same score.  Without documents or
without items with terms the result is empty.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackyard.llm.common import saved

BLOCK_BYTES = 2 << 20
SLAB = 1 << 20            # bytes of a text cut into terms at a time
QUERY_TERMS = 200_000     # terms of items that one pass over the index searches for
TOP = 50

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32
               for b in range(256))

INDEX = ("n_docs bigint, n_terms bigint, ids binary, nulls binary, lengths binary, terms binary, "
         "starts binary, docs binary, tfs binary")
IMPACTS = ("ids binary, nulls binary, term_nos binary, term_starts binary, docs binary, scores binary, "
           "term_max binary, pair_nos binary, pair_starts binary, pair_docs binary, pair_max binary")


def terms(text: str):
    """Terms of a text as UTF-8 bytes, a slab at a time."""
    raw = text.encode("utf-8", "surrogatepass").translate(_TABLE)
    start = 0
    while start < len(raw):
        end = raw.find(b" ", start + SLAB)
        end = len(raw) if end < 0 else end
        yield raw[start:end].split()
        start = end


def _row(schema: str, values) -> object:
    import pyarrow as pa
    kinds = {"bigint": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.record_batch([pa.array([v.tobytes() if isinstance(v, np.ndarray) else v], kinds[t])
                            for v, (_, t) in zip(values, fields)], names=[n for n, _ in fields])


def _rows(batches, schema: str):
    """Rows as dictionaries, one at a time."""
    names = [f.split()[0] for f in schema.split(", ")]
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in names}


def _indexer(batches):
    def new():
        return defaultdict(count().__next__), [], [], []

    def built():
        n = len(ids)
        words = list(numbers)
        order = sorted(range(len(words)), key=words.__getitem__)
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        doc = np.repeat(np.arange(n, dtype=np.int64), lengths)
        keys, tfs = np.unique(rank[np.concatenate(parts)] * n + doc, return_counts=True)
        starts = np.searchsorted(keys, np.arange(len(words) + 1, dtype=np.int64) * n)
        return _row(INDEX, (n, sum(lengths), np.array([i or 0 for i in ids], np.int64),
                            np.array([i is None for i in ids]), np.array(lengths, np.int64),
                            b" ".join(words[i] for i in order), starts.astype(np.int32),
                            (keys % n).astype(np.int32), tfs.astype(np.int32)))

    numbers, ids, lengths, parts = new()
    size = 0
    for batch in batches:
        for key, text in zip(batch.column("id"), batch.column("text")):
            total, text = 0, text.as_py()
            for words in terms(text):
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                total += len(words)
            if not total:
                continue
            ids.append(key.as_py())
            lengths.append(total)
            size += len(text)
            if size > BLOCK_BYTES:
                yield built()
                numbers, ids, lengths, parts = new()
                size = 0
    if ids:
        yield built()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per block of documents; every term of every text."""
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"),
                       F.col(f"`{text_col}`").cast("string").alias("text")).where("text IS NOT NULL")
    return saved(rows.mapInArrow(_indexer, INDEX), "search-index")


def _item_terms(batches):
    import pyarrow as pa
    for batch in batches:
        for i in range(batch.num_rows):
            found: set[bytes] = set()
            for words in terms(batch.column("text")[i].as_py()):
                found.update(words)
            yield pa.record_batch([pa.array([batch.column("item")[i].as_py()] * len(found), pa.int64()),
                                   pa.array(sorted(found), pa.binary())], names=["item", "term"])


class Items:
    """A bounded set of items: their distinct terms numbered, paired and weighted."""

    def __init__(self, rows: list[tuple[int | None, bytes]]):
        self.terms = sorted({t for _, t in rows})
        number = {t: i for i, t in enumerate(self.terms)}
        own = defaultdict(list)
        for item, term in rows:
            own[item].append(number[term])
        self.items, self.own = list(own), list(own.values())
        self.weights = np.zeros(len(self.terms), np.int64)
        self.n_docs = self.n_terms = 0

    def weigh(self, n_docs: int, n_terms: int, df: dict[int, int]) -> None:
        """Weights by document frequency; then the terms of each item paired by rising weight."""
        self.n_docs, self.n_terms = n_docs, n_terms
        for t, n in df.items():
            self.weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
        numbers: dict[tuple[int, int], int] = {}
        units = []
        none, widest = len(self.terms), max(map(len, self.own))
        for own in self.own:
            known = sorted((t for t in own if df.get(t)), key=lambda t: (self.weights[t], t))
            row = [(a, b, numbers.setdefault((min(a, b), max(a, b)), len(numbers)))
                   for a, b in zip(known[::2], known[1::2])]
            if len(known) % 2:
                row.append((known[-1], none, -1))
            units.append(row + [(none, none, -1)] * ((widest + 1) // 2 - len(row)))
        self.pairs = np.array(list(numbers) or np.zeros((0, 2)), np.int64).reshape(-1, 2)
        self.units = np.array(units, np.int64)   # item x pair x (term, term, pair number)


def _postings(row: dict, wanted: dict[bytes, int]):
    """``(numbers, starts, ends)`` of the wanted terms that the block holds."""
    words = row["terms"].split(b" ")
    at = [(wanted[w], i) for i, w in enumerate(words) if w in wanted]
    at.sort()
    numbers, places = (np.array(c, np.int64) for c in zip(*at)) if at else (np.zeros(0, np.int64),) * 2
    starts = np.frombuffer(row["starts"], np.int32).astype(np.int64)
    return numbers, starts[places], starts[places + 1]


def _frequencies(items: Items):
    wanted = {t: i for i, t in enumerate(items.terms)}

    def run(batches):
        import pyarrow as pa
        total = np.zeros(len(wanted), np.int64)
        for row in _rows(batches, "terms binary, starts binary"):
            numbers, starts, ends = _postings(row, wanted)
            total[numbers] += ends - starts
        there = np.flatnonzero(total)
        yield pa.record_batch([pa.array(there), pa.array(total[there])], names=["term", "df"])
    return run


def _preparer(items: Items):
    wanted = {t: i for i, t in enumerate(items.terms)}

    def run(batches):
        for row in _rows(batches, INDEX):
            n = row["n_docs"]
            numbers, starts, ends = _postings(row, wanted)
            docs, tfs = (np.frombuffer(row[c], np.int32) for c in ("docs", "tfs"))
            m = 50 + (50 * np.frombuffer(row["lengths"], np.int64) * items.n_docs) // items.n_terms
            sizes = ends - starts
            rows = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            docs, tfs = docs[rows], tfs[rows].astype(np.int64)
            scores = np.repeat(items.weights[numbers], sizes) * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[docs]))
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            largest = np.maximum.reduceat(scores, bounds[:-1]) if len(scores) else np.zeros(0, np.int64)
            place = np.full(len(wanted) + 1, -1, np.int64)
            place[numbers] = np.arange(len(numbers))
            own = np.full(n, -1, np.int64)
            pair_nos, pair_docs, pair_max = [], [], []
            for no in np.flatnonzero((place[items.pairs] >= 0).all(1)).tolist():
                a, b = place[items.pairs[no]]
                in_a = docs[bounds[a]:bounds[a + 1]]
                own[in_a] = scores[bounds[a]:bounds[a + 1]]
                in_b = docs[bounds[b]:bounds[b + 1]]
                first = own[in_b]
                own[in_a] = -1
                both = first >= 0
                if both.any():
                    pair_nos.append(no)
                    pair_docs.append(in_b[both])
                    pair_max.append(int((first + scores[bounds[b]:bounds[b + 1]])[both].max()))
            yield _row(IMPACTS, (
                row["ids"], row["nulls"], numbers, bounds, docs, scores, largest, np.array(pair_nos, np.int64),
                np.concatenate([[0], np.cumsum([len(d) for d in pair_docs], dtype=np.int64)]).astype(np.int64),
                np.concatenate([*pair_docs, np.zeros(0, np.int32)]).astype(np.int32), np.array(pair_max, np.int64)))
    return run


class Block:
    """One row of the prepared index, with its bounds."""

    def __init__(self, row: dict, n_terms: int, n_pairs: int):
        get = lambda c, kind=np.int64: np.frombuffer(row[c], kind)
        self.ids, self.nulls = get("ids"), get("nulls", np.bool_)
        self.docs, self.scores, self.starts = get("docs", np.int32), get("scores"), get("term_starts")
        self.pair_docs, self.pair_starts = get("pair_docs", np.int32), get("pair_starts")
        self.place, self.largest = np.full(n_terms + 1, -1, np.int64), np.zeros(n_terms + 1, np.int64)
        self.place[get("term_nos")] = np.arange(len(get("term_nos")))
        self.largest[get("term_nos")] = get("term_max")
        self.pair_place, self.joint = np.full(n_pairs + 1, -1, np.int64), np.zeros(n_pairs + 1, np.int64)
        self.pair_place[get("pair_nos")] = np.arange(len(get("pair_nos")))
        self.joint[get("pair_nos")] = get("pair_max")

    def add(self, term: int, to: np.ndarray) -> None:
        p = self.place[term]
        if p >= 0:
            a, b = self.starts[p], self.starts[p + 1]
            to[self.docs[a:b]] += self.scores[a:b]   # a document stands once in a list

    def both(self, pair: int) -> np.ndarray:
        p = self.pair_place[pair]
        return self.pair_docs[self.pair_starts[p]:self.pair_starts[p + 1]] if p >= 0 else self.pair_docs[:0]

    def bounds(self, units: np.ndarray) -> np.ndarray:
        """What a document can take from each unit: the best single term, or both together."""
        return np.maximum(np.maximum(self.largest[units[..., 0]], self.largest[units[..., 1]]),
                          self.joint[units[..., 2]])

    def scored(self, units: np.ndarray, bounds: np.ndarray, least: int) -> np.ndarray:
        """Scores of one item: right for every document of at least ``least``, below it for the others."""
        order = np.argsort(bounds, kind="stable")
        sums = np.cumsum(bounds[order])
        cut = int(np.searchsorted(sums, least))     # units before it stay below the threshold together
        acc = np.zeros(len(self.ids), np.int64)
        for u in order[cut:].tolist():
            if bounds[u]:
                self.add(units[u, 0], acc)
                self.add(units[u, 1], acc)
        for j in range(cut - 1, -1, -1):
            u = order[j]
            if not bounds[u]:
                break
            a, b, pair = units[u].tolist()
            gain = np.full(len(acc), max(self.largest[a], self.largest[b]))
            gain[self.both(pair)] = bounds[u]
            rest = int(sums[j - 1]) if j else 0
            if not ((acc > 0) & (acc + gain + rest >= least)).any():
                break
            self.add(a, acc)
            self.add(b, acc)
        return acc


def _searcher(items: Items, top: int):
    def run(batches):
        import pyarrow as pa
        none = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        best = [none] * len(items.items)                 # per item: ids, null ids, scores
        least = np.ones(len(items.items), np.int64)      # what a document needs to enter
        for row in _rows(batches, IMPACTS):
            block = Block(row, len(items.terms), len(items.pairs))
            bounds = block.bounds(items.units)
            for i in np.flatnonzero(bounds.sum(1) >= least).tolist():
                acc = block.scored(items.units[i], bounds[i], int(least[i]))
                found = np.flatnonzero(acc >= least[i])
                if not len(found):
                    continue
                ids, nulls, scores = (np.concatenate(c) for c in zip(
                    best[i], (block.ids[found], block.nulls[found], acc[found])))
                order = np.lexsort((ids, nulls, -scores))[:top]
                best[i] = ids[order], nulls[order], scores[order]
                if len(order) == top:
                    least[i] = scores[order[-1]]
        for item, (ids, nulls, scores) in zip(items.items, best):
            yield pa.record_batch([pa.array([item] * len(ids), pa.int64()), pa.array(ids, mask=nulls),
                                   pa.array(scores)], names=["item", "doc", "score"])
    return run


def prepared(index: DataFrame, items: Items) -> DataFrame:
    """Scores, intersection lists and joint maxima of the items' terms and pairs, per block."""
    return saved(index.mapInArrow(_preparer(items), IMPACTS), "search-impacts")


def search(index: DataFrame, queries: DataFrame, item_col: str = "item_id", text_col: str = "text",
           top: int = TOP) -> DataFrame:
    """``(item, rank, doc, score)``: the ``top`` best documents of each item, ``score`` above 0.

    Items are searched for in groups of about ``QUERY_TERMS`` terms (one item at
    least), each group in one pass over the index; a group is all that reaches the driver.
    """
    wanted = saved(queries.select(F.col(f"`{item_col}`").cast("bigint").alias("item"),
                                  F.col(f"`{text_col}`").cast("string").alias("text")).where("text IS NOT NULL")
                   .mapInArrow(_item_terms, "item bigint, term binary").distinct(), "search-items")
    totals = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    groups = max(1, -(-wanted.count() // QUERY_TERMS))
    found = None
    for g in range(groups):
        rows = wanted.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g).collect()
        if not rows or not totals[0]:
            continue
        items = Items([(r["item"], bytes(r["term"])) for r in rows])
        df = index.select("terms", "starts").mapInArrow(_frequencies(items), "term bigint, df bigint") \
            .groupBy("term").agg(F.sum("df").alias("df")).collect()
        items.weigh(totals[0], totals[1], {r["term"]: r["df"] for r in df})
        part = prepared(index, items).mapInArrow(_searcher(items, top), "item bigint, doc bigint, score bigint")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = index.sparkSession.createDataFrame([], "item bigint, doc bigint, score bigint")
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(
        "item", "rank", "doc", "score")


def ranked(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", query_col: str = "text", top: int = TOP) -> DataFrame:
    """Index ``docs`` and search for the items of ``queries``: ``item_col, rank, id_col, score``."""
    return search(build_index(docs, id_col, text_col), queries, item_col, query_col, top).select(
        F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
