"""Plan shape checks: no cross products anywhere, pushdown to the scan,
partial aggregation before shuffles."""

import pytest

import __spark_entry__ as E

SMALL = "/root/testdata/sf0.001"
QUERIES = E.queries()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_product(spark, name):
    plan = _plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = _plan(QUERIES["f1_prefix_filter"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(p_name), StringStartsWith(p_name,hot)]" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in plan


def test_aggregates_are_partial_before_the_shuffle(spark):
    plan = _plan(QUERIES["r10_daily_activity"](spark, SMALL))
    assert "partial_count" in plan


def test_range_scan_pushes_bounds(spark):
    from stackyard.operators.versions import scan
    df = spark.read.parquet(f"{SMALL}/customer.parquet")
    plan = _plan(scan(df.withColumnRenamed("c_name", "row_key"), "Customer#0000001",
                      "Customer#0000002"))
    assert "GreaterThanOrEqual(row_key" not in plan  # renamed column maps back to c_name
    assert "GreaterThanOrEqual(c_name,Customer#0000001)" in plan
