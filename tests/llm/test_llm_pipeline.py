import corpus_pipeline as pipeline
from brute import near_components
from conftest import SMALL
from edge import table

import __spark_entry__ as E
from stackyard.llm import toxicity
from stackyard.llm.queries import ORACLES, QUERIES
from stackyard.tables import load


def test_stages_one_after_the_other_against_brute_force(spark):
    docs = load(spark, SMALL, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    scores = toxicity.toxicity(docs, load(spark, SMALL, "labels")).collect()
    expected = {r.doc_id for r in scores if not r.predicted}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns
        if name == "exact_dedup":
            last = {}
            for i in sorted(expected):
                last[texts[i]] = i
            expected = set(last.values())
        if name == "near_dedup":
            groups = near_components([(i, texts[i]) for i in expected])
            expected = {i for i, (_, _, kept) in groups.items() if kept}
        assert {r.doc_id for r in docs.collect()} == expected
    rows = pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in rows} == expected


def test_run_is_the_stages(spark):
    got = pipeline.run(spark, SMALL)
    docs = load(spark, SMALL, "documents")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert got.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert got.columns == docs.columns


def test_stages_keep_awkward_columns(spark):
    docs = table(spark)
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == table(spark).columns
    assert docs.count() > 0


def test_registered():
    names = E.queries()
    assert names["pipeline"] is pipeline.run
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) <= set(names) and set(ORACLES) <= set(E.oracle_sql())
