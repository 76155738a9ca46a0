import hashlib
from collections import Counter

import pytest
from brute import near_components
from conftest import SMALL
from edge import BASE, ROWS, table

from stackyard.llm import exact_dedup as exact
from stackyard.llm import minmax_dedup as near
from stackyard.llm.components import components
from stackyard.llm.queries import QUERIES


def documents(spark):
    return [(r.doc_id, r.text) for r in
            spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("block", [16, 1024])
def test_exact_dedup_of_awkward_rows(spark, block):
    got = exact.exact_dedup(table(spark), block_bytes=block).collect()
    assert len(got) == len(ROWS)
    groups = Counter(t or "" for _, t in ROWS)
    keep = {}
    for i, t in ROWS:
        if i is not None:
            keep[t or ""] = max(i, keep.get(t or "", -1))
    texts = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for r in got:
        t = texts[r.text_sha256]
        assert (r.keep_id, r.group_size) == (keep.get(t), groups[t])
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(texts.keys())
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_starts_again_when_keys_clash(spark, monkeypatch):
    seeds = []
    original = exact._block_names

    def clashing(rows, size, seed):
        seeds.append(seed)
        return None if seed < 2 else original(rows, size, seed)

    monkeypatch.setattr(exact, "_block_names", clashing)
    assert exact.exact_dedup(table(spark), block_bytes=64).filter("kept").count() == len({t or "" for _, t in ROWS})
    assert seeds == [0, 1, 2]


def test_exact_dedup_plan_has_no_python(spark):
    plan = exact.exact_dedup(table(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_exact_dedup_of_nothing(spark):
    assert exact.exact_dedup(table(spark, [])).collect() == []
    assert exact.drop_copies(table(spark, [])).collect() == []


def test_drop_copies_keeps_all_columns(spark):
    docs = table(spark)
    got = exact.drop_copies(docs, block_bytes=64)
    assert got.columns == docs.columns
    assert sorted((r.text or "") for r in got.collect()) == sorted({t or "" for _, t in ROWS})


def test_near_duplicates_equal_brute_force(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept)
           for r in QUERIES["op1_minmax_dedup"](spark, SMALL).collect()}
    assert got == near_components(documents(spark))


def test_near_duplicates_of_awkward_rows(spark):
    rows = [(i, t) for i, t in ROWS if i is not None]
    got = near.near_duplicates(table(spark)).collect()
    assert len(got) == len(ROWS)
    expected = near_components(list(dict(rows).items()))
    for r in got:
        if r.doc_id not in (None, 13):
            assert (r.n_shingles, r.component_id, r.kept) == expected[r.doc_id]
    null = sorted(((r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None), key=str)
    assert null == sorted([(len(BASE.split()) - 4, 1, False), (1, None, True), (0, None, True)], key=str)
    assert sorted(r.kept for r in got if r.doc_id == 13) == [False, True]


def crowd_of_documents():
    """Documents that share a long passage, in families of near copies."""
    import random
    rng = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    passage = rng.choices(words, k=120)
    rows = []
    for family in range(60):
        own = rng.choices(words, k=80)
        for _ in range(3):
            body = passage + own
            body[rng.randrange(200)] = "changed"
            rows.append((len(rows), " ".join(body)))
    return rows


@pytest.mark.parametrize("crowd", [64, 4, 1])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, crowd):
    monkeypatch.setattr(near, "CROWD", crowd)
    monkeypatch.setattr(near, "PART", 4 * crowd)
    monkeypatch.setattr(near, "COLUMNS", 50)
    docs = crowd_of_documents()
    rows = near.texts(table(spark, docs)).selectExpr("monotonically_increasing_id() AS rid", "id", "text")
    got = {r.id: (r.n_shingles, r.component_id, r.kept)
           for r in near._groups(rows, 5, 75).collect()}
    assert got == near_components(docs)


def test_near_duplicates_is_defined_once():
    import ast
    import inspect
    names = [n.name for n in ast.parse(inspect.getsource(near)).body if isinstance(n, ast.FunctionDef)]
    assert sorted(set(names)) == sorted(names)


@pytest.mark.parametrize("columns", [1 << 13, 7])
def test_parts_are_compared_across(monkeypatch, columns):
    import pyarrow as pa
    monkeypatch.setattr(near, "COLUMNS", columns)
    body = " ".join(f"w{i}" for i in range(100))
    texts = [body + f" x{i}" for i in range(6)] + ["something else of some more words"]

    def links(part):
        rows = pa.table({"node": range(7), "root": range(7), "part": part, "text": texts})
        return [(r["a"], r["b"]) for r in near._group_comparer(5, 75)(rows).to_pylist()]

    across = links([0, 0, 0, 4, 4, 4, 4])
    assert len(across) == 5 and all(a < 3 <= b < 6 for a, b in across)
    assert all(b < 3 <= a < 6 for a, b in links([4, 4, 4, 0, 0, 0, 0]))
    assert len(links([2] * 7)) == 5 and {n for link in links([2] * 7) for n in link} == set(range(6))


def test_near_duplicates_of_nothing(spark):
    assert near.near_duplicates(table(spark, [])).collect() == []
    assert near.near_duplicates(table(spark, [(1, None), (2, " ")])).filter("kept").count() == 2


def test_drop_near_duplicates_keeps_all_columns(spark):
    docs = table(spark)
    got = near.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    kept = near.near_duplicates(docs).filter("kept")
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r.doc_id) for r in kept.collect())


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (901, 901), (901, 900)],
                                  "a bigint, b bigint")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {900: 900, 901: 900}
    assert components(edges.limit(0)).collect() == []


def test_near_duplicates_broadcast_nothing(spark, monkeypatch):
    from stackyard.llm import components as contraction
    plans = []

    def plan(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    def recorded(df, label, write=near.saved):
        return write(plan(df), label)

    monkeypatch.setattr(near, "CROWD", 4)
    monkeypatch.setattr(near, "saved", recorded)
    monkeypatch.setattr(contraction, "saved", recorded)
    docs = table(spark, crowd_of_documents()[:30])
    assert plan(near.drop_near_duplicates(docs)).count() == 10
    assert sum("SortMergeJoin" in p for p in plans) > 10
    assert not [p for p in plans if "Broadcast" in p]
