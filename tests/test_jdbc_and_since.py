"""IO8-IO10 argument handling and IO9 on a file source.  No database is
started here (see README), so the jdbc reads themselves are not run."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackyard.sources import text as TX
from stackyard.sources.jdbc import import_jdbc, import_since


def test_partitioned_import_needs_bounds(spark):
    with pytest.raises(ValueError):
        import_jdbc(spark, "jdbc:example://db/meta", "customer", key="c_custkey", n=4)


def test_import_since_pushes_the_mark_and_returns_the_new_one(spark):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_orderdate")
    mark = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    rows, new_mark = import_since(o, "o_orderdate", mark)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderdate" in plan
    assert rows.count() == o.where(F.col("o_orderdate") > mark).count()
    assert new_mark.first()[0] == o.agg(F.max("o_orderdate")).first()[0]


def test_read_delimited_casts_to_the_schema(spark, tmp_dir):
    import os
    p = os.path.join(tmp_dir, "typed.txt")
    with open(p, "w") as f:
        f.write("1 2.5 a\nx 3 b\n")
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("d", T.DoubleType()),
                           T.StructField("s", T.StringType())])
    rows, _ = TX.read_delimited(spark, p, schema)
    got = sorted((r.i, r.d, r.s) for r in rows.collect() if r.i is not None)
    assert got == [(1, 2.5, "a")]
    assert rows.where(F.col("i").isNull()).count() == 1  # 'x' does not cast: NULL, not an error
