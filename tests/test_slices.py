"""Windows, frames and range joins over slices, against Spark's own windows and brute force, with a hot key."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stackyard.operators import aggregates as A
from stackyard.operators import ordinal as O
from stackyard.operators.ranges import _cells, range_frame, range_join, range_totals

SLICES = [1, 7, 400]   # 400 slices of a few rows each: frames reach over several of them


@pytest.fixture(scope="module")
def skewed(spark):
    # key 0 holds 40 % of the rows, one value of it 10 %; nulls in key, order and value
    return spark.range(0, 3000).select(
        F.when(F.col("id") % 10 < 4, 0).when(F.col("id") % 97 == 5, None).otherwise(F.col("id") % 37).alias("k"),
        F.when(F.col("id") % 10 == 1, 50).when(F.col("id") % 61 == 7, None).otherwise(F.col("id") * 7919 % 211).alias("v"),
        F.when(F.col("id") % 7 == 3, None).otherwise((F.col("id") * 31 % 1009)).alias("x"), "id")


def by_id(df, *cols):
    return {r["id"]: tuple(r[c] for c in cols) for r in df.collect()}


@pytest.mark.parametrize("n", SLICES)
def test_window_values_equal_plain_windows(skewed, n):
    got = O.over(skewed, ["k"], ["v", "id"], {
        "lag3": O.lag("x", 3), "lag1": O.lag("v"), "lead2": O.lead("x", 2), "first": O.first("id"), "last": O.last("id"),
        "lo": O.rows_frame(F.min, "x", 6), "hi": O.rows_frame(F.max, "x", 2, 3), "n": O.rows_frame(F.count, "x", 6),
        "s": O.rows_frame(F.sum, "x", 0, 4)}, partitions=n)
    w = Window.partitionBy("k").orderBy("v", "id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    exp = skewed.select("id", F.lag("x", 3).over(w).alias("lag3"), F.lag("v").over(w).alias("lag1"),
                        F.lead("x", 2).over(w).alias("lead2"), F.first("id").over(whole).alias("first"),
                        F.last("id").over(whole).alias("last"), F.min("x").over(w.rowsBetween(-6, 0)).alias("lo"),
                        F.max("x").over(w.rowsBetween(-2, 3)).alias("hi"), F.count("x").over(w.rowsBetween(-6, 0)).alias("n"),
                        F.sum("x").over(w.rowsBetween(0, 4)).alias("s"))
    cols = ("lag3", "lag1", "lead2", "first", "last", "lo", "hi", "n", "s")
    assert got.columns == [*skewed.columns, *cols]
    assert by_id(got, *cols) == by_id(exp, *cols)


@pytest.mark.parametrize("n", SLICES)
@pytest.mark.parametrize("descending", [True, False])
def test_ranks_with_ties_over_many_slices(skewed, n, descending):
    got = O.ranks(skewed, ["k"], "v", "id", descending=descending, tiles=7, partitions=n)
    v = F.col("v").desc() if descending else F.col("v").asc()
    w, wv = Window.partitionBy("k").orderBy(v, "id"), Window.partitionBy("k").orderBy(v)
    exp = skewed.select("id", F.row_number().over(w).alias("row_number"), F.rank().over(wv).alias("rank"),
                        F.dense_rank().over(wv).alias("dense_rank"), F.ntile(7).over(w).alias("ntile"))
    cols = ("row_number", "rank", "dense_rank", "ntile")
    assert by_id(got, *cols) == by_id(exp, *cols)


@pytest.mark.parametrize("n", SLICES)
@pytest.mark.parametrize("width", [20, 3, 1000])
def test_range_frames_equal_plain_windows(skewed, n, width):
    got = range_frame(skewed, ["k"], "v", width, {"lo": ("min", "x"), "hi": ("max", "x"), "s": ("sum", "x"),
                                                  "n": ("count", "x"), "m": ("count", None)}, partitions=n)
    w = Window.partitionBy("k").orderBy("v").rangeBetween(-width, 0)
    exp = skewed.select("id", F.min("x").over(w).alias("lo"), F.max("x").over(w).alias("hi"), F.sum("x").over(w).alias("s"),
                        F.count("x").over(w).alias("n"), F.count(F.lit(1)).over(w).alias("m"))
    assert got.columns == [*skewed.columns, "lo", "hi", "s", "n", "m"]
    cols = ("lo", "hi", "s", "n", "m")
    assert by_id(got, *cols) == by_id(exp, *cols)


def test_range_frames_over_times_and_doubles(spark, skewed):
    times = skewed.withColumn("t", F.expr("timestampadd(HOUR, CAST(v AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00')"))
    got = range_frame(times, ["k"], "t", "20 hours", {"hi": ("max", "x")}, partitions=9)
    plain = range_frame(skewed, ["k"], "v", 20, {"hi": ("max", "x")}, partitions=3)
    assert by_id(got, "hi") == by_id(plain, "hi")
    tenths = skewed.withColumn("d", F.col("v") / 8)
    assert by_id(range_frame(tenths, ["k"], "d", 2.5, {"hi": ("max", "x")}, partitions=50), "hi") == by_id(plain, "hi")


@pytest.mark.parametrize("n", SLICES)
def test_range_totals_equal_a_plain_join(skewed, n):
    left = skewed.select("id", "k", (F.col("v") - F.col("id") % 13).alias("lo"), (F.col("v") + F.col("id") % 29).alias("hi"))
    right = skewed.select("k", F.col("v").alias("at"), "x")
    got = range_totals(left, right, "k", "lo", "hi", "at", "x", partitions=n)
    pairs = left.join(right.withColumnRenamed("k", "rk"), (F.col("k") == F.col("rk")) & F.col("at").between(F.col("lo"), F.col("hi")))
    exp = left.join(pairs.groupBy("id").agg(F.count("at").alias("n"), F.sum("x").alias("total")), "id", "left").fillna(0, ["n"])
    assert by_id(got, "n", "total") == by_id(exp, "n", "total")


def test_one_shuffle_by_range_and_no_rows_joined_with_rows(spark, skewed):
    plan = O.over(skewed, ["k"], ["v", "id"], {"a": O.lag("x"), "b": O.last("x")}, partitions=8)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in text and text.count("BroadcastHashJoin") == 2
    ranks = O.ranks(skewed, ["k"], "v", "id", tiles=4, partitions=8)._jdf.queryExecution().executedPlan().toString()
    # rows of whole tables are only read: what is shuffled are the edge rows of slices
    assert "_pos" in ranks and "rangepartitioning" not in ranks


def test_dyadic_cells_cover_each_integer_once(spark):
    rows = spark.createDataFrame([(a, a + w) for a in (-70, -1, 0, 1, 5, 64, 1000) for w in (0, 1, 2, 7, 63, 64, 200)],
                                 "a bigint, b bigint")
    for r in rows.select("a", "b", _cells(F.col("a"), F.col("b")).alias("c")).collect():
        covered = [x for c in r.c for x in range(c.cell << c.level, (c.cell + 1) << c.level)]
        assert sorted(covered) == list(range(r.a, r.b + 1))
        assert len(r.c) <= 2 * (r.b - r.a + 1).bit_length()


@pytest.mark.parametrize("unit", [0.25, 3.0, 1000.0])
def test_range_join_finds_each_pair_once(spark, unit):
    left = spark.range(300).select(
        F.col("id").alias("l"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise("k").alias("k"),
        ((F.col("id") * 37 % 101) / 4 - 10).alias("lo"), F.when(F.col("id") % 31 != 2, (F.col("id") * 37 % 101) / 4 - 11
                                                                + F.col("id") % 40).alias("hi"))
    right = spark.range(400).select(F.col("id").alias("r"), F.when(F.col("id") % 4 == 0, "k").otherwise("hot").alias("k"),
                                    F.when(F.col("id") % 41 != 3, (F.col("id") * 53 % 211) / 8 - 10).alias("at"))
    got = range_join(left, right, ["k"], "lo", "hi", "at", unit=unit)
    pairs = sorted((r.l, r.r) for r in got.collect())
    exp = left.join(right.withColumnRenamed("k", "rk"), (F.col("k") == F.col("rk")) & F.col("at").between(F.col("lo"), F.col("hi")))
    assert pairs == sorted((r.l, r.r) for r in exp.collect()) and len(pairs) > 1000
    assert sorted(got.columns) == ["at", "hi", "k", "l", "lo", "r"]
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_parts_of_one_hot_key_put_together_are_the_whole(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 50 == 0, "cold").otherwise("hot").alias("k"), "id",
                                  F.when(F.col("id") % 9 != 4, F.concat(F.lit("wörd"), "id")).alias("v"))
    for lead in (False, True):
        whole = {r.k: r.joined for r in A.ordered_concat(df, ["k"], "v", ["id"], ", ", lead).collect()}
        parts = A.concat_parts(df, ["k"], "v", ["id"], ", ", lead, part_bytes=500, partitions=12).collect()
        for key, text in whole.items():
            own = sorted((r.part, r.joined) for r in parts if r.k == key)
            assert "".join(t for _, t in own) == text
            assert all(len(t.encode()) <= 500 + 20 for _, t in own)
        assert len(parts) > 90
