import math
import re
from collections import Counter

import duckdb
import pytest
from conftest import SMALL
from edge import table
from helpers import same

from stackyard.llm import pair_maxscore as pm
from stackyard.llm.queries import ORACLES, QUERIES
from stackyard.tables import load

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def model(docs, items, top=50):
    bags = [(d, Counter(words(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    of = {}
    for item, text in items:
        of.setdefault(item, set()).update(words(text))
    out = []
    for item, own in of.items():
        scored = []
        for d, b in bags:
            m = 50 + (50 * sum(b.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * ((10**9 * b[t]) // (1000 * b[t] + 20 * m)) for t in own if t in b)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        scored.sort()
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(scored[:top])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def items_table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "item_id bigint, text string, doc_id int, item string, term string")


def test_search_query_equals_sql_and_brute_force(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    cur = con.execute(ORACLES["op13_search"])
    expected = [d[0] for d in cur.description], cur.fetchall()
    assert same(QUERIES["op13_search"](spark, SMALL), expected)
    docs, items = ([tuple(r) for r in load(spark, SMALL, t).select(k, "text").collect()]
                   for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    at = [expected[0].index(c) for c in ("item_id", "rank", "doc_id", "score")]
    assert sorted((tuple(r[i] for i in at) for r in expected[1]), key=repr) == model(docs, items)


@pytest.mark.parametrize("block,group", [(300, 5), (4000, 10**6)])
def test_search_edge_rows_in_small_blocks(spark, monkeypatch, block, group):
    monkeypatch.setattr(pm, "BLOCK_BYTES", block)
    monkeypatch.setattr(pm, "QUERY_TERMS", group)
    docs = [(i, f"alpha beta {'gamma ' * (i % 4)}{'delta ' * (i % 7)} Straße-{i % 11} 日本語 {'pad ' * (i % 13)}") for i in range(150)]
    docs += [(None, "alpha gamma delta"), (None, None), (3, ""), (4, " \t-?"), (5, "alpha"), (5, "alpha"), (6, "ALPHA \u0080  x")]
    items = [(1, "gamma delta alpha"), (2, "nothing here"), (3, None), (4, ""), (5, "STRASSE Straße 日本語"), (1, "beta"),
             (None, "pad 3"), (6, "alpha alpha alpha"), (7, "\u0080")]
    for top in (1, 5, 50):
        result = pm.ranked(table(spark, docs).repartition(2), items_table(spark, items), top=top)
        assert result.columns == ["item_id", "rank", "doc_id", "score"]
        assert got(result) == model(docs, items, top)


def test_search_of_empty_tables(spark):
    for docs, items in (([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, "-")])):
        assert pm.ranked(table(spark, docs), items_table(spark, items)).collect() == []


def test_very_long_documents(spark):
    docs = [(1, "needle " + "hay stack " * 500_000), (2, "needle hay"), (3, "hay " * 10)]
    items = [(1, "needle"), (2, "hay stack")]
    assert got(pm.ranked(table(spark, docs), items_table(spark, items))) == model(docs, items)


def test_bounds_hold_for_every_document(spark):
    docs, items = ([tuple(r) for r in load(spark, SMALL, t).select(k, "text").collect()]
                   for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    index = pm.build_index(table(spark, docs))
    known = pm.Items([(i, t.encode()) for i, text in items for t in set(words(text))])
    totals = index.agg({"n_docs": "sum", "n_terms": "sum"}).first().asDict()
    df = Counter(t for _, text in docs for t in set(words(text)))
    known.weigh(totals["sum(n_docs)"], totals["sum(n_terms)"],
                {i: df[t.decode()] for i, t in enumerate(known.terms) if df[t.decode()]})
    tighter = 0
    for row in pm.prepared(index, known).collect():
        block = pm.Block(row.asDict(), len(known.terms), len(known.pairs))
        for units, bounds in zip(known.units, block.bounds(known.units)):
            exact = block.scored(units, bounds, 0)
            assert exact.max() <= bounds.sum()
            single = block.largest[units[:, 0]] + block.largest[units[:, 1]]
            assert (bounds <= single).all()
            tighter += int((bounds < single).sum())
            for least in (1, int(exact.max()) // 2 + 1, int(exact.max())):
                part = block.scored(units, bounds, least)
                assert ((part == exact) | (exact < least)).all() and (part[exact < least] < max(least, 1)).all()
    assert tighter > 100
