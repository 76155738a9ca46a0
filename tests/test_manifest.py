"""Versioned tables: commits are one step, whatever the step at which a writer dies."""

import pytest
from pyspark.sql import functions as F

from stackyard.session import scratch_path
from stackyard.sources.manifest import BUCKET, Conflict, VersionedTable, bucket_of


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def changes(spark, *pairs):
    return spark.createDataFrame([(k, v, n) for k, v, n in pairs], "k string, v int, n int")


class Killed(Exception):
    pass


STEPS = ("_stage", "_files", "_put_aside", "_publish", "after")


def dying(table, step):
    """``table`` whose writer dies just before ``step`` (``after``: just after the commit)."""
    def die(*args, **kwargs):
        raise Killed(step)

    if step == "after":
        commit = table._commit

        def done(*args):
            commit(*args)
            raise Killed(step)
        table._commit = done
    else:
        setattr(table, step, die)
    return table


@pytest.mark.parametrize("step", STEPS)
def test_a_killed_upsert_is_seen_whole_or_not_at_all_and_replays(spark, step):
    path = scratch_path(spark, "t-manifest")
    table = VersionedTable(spark, path)
    table.upsert(changes(spark, ("a", 1, 0), ("b", 1, 0), ("c", 1, 0)), ["k"], ["n"], 4, "w", 0)
    old, new = [("a", 1, 0), ("b", 1, 0), ("c", 1, 0)], [("a", 1, 0), ("b", 2, 1), ("c", 1, 0), ("d", 2, 1)]
    second = changes(spark, ("b", 2, 1), ("d", 2, 1), ("a", 0, -1))
    with pytest.raises(Killed):
        dying(VersionedTable(spark, path), step).upsert(second, ["k"], ["n"], 4, "w", 1)
    assert rows(table.read()) == (new if step == "after" else old)
    table.upsert(second, ["k"], ["n"], 4, "w", 1)   # the replay
    assert rows(table.read()) == new and len(table.versions()) == 2
    table.upsert(second, ["k"], ["n"], 4, "w", 1)   # known by its batch id
    assert len(table.versions()) == 2


@pytest.mark.parametrize("step", STEPS)
def test_a_killed_replace_leaves_a_whole_table(spark, step):
    path = scratch_path(spark, "t-manifest")
    table = VersionedTable(spark, path)
    table.replace(spark.range(3))
    with pytest.raises(Killed):
        dying(VersionedTable(spark, path), step).replace(spark.range(10, 12))
    assert rows(table.read()) == ([(10,), (11,)] if step == "after" else [(0,), (1,), (2,)])
    table.replace(spark.range(10, 12))
    assert rows(table.read()) == [(10,), (11,)]


def test_of_two_writers_one_is_told_and_starts_again(spark):
    path = scratch_path(spark, "t-manifest")
    first, second = VersionedTable(spark, path), VersionedTable(spark, path)
    first.upsert(changes(spark, ("a", 1, 0)), ["k"], ["n"], 2)
    publish, raced = second._publish, []

    def late(aside, version):
        if not raced:
            raced.append(first.upsert(changes(spark, ("b", 1, 0)), ["k"], ["n"], 2))
        publish(aside, version)
    second._publish = late
    second.upsert(changes(spark, ("c", 1, 0)), ["k"], ["n"], 2)
    assert rows(first.read()) == [("a", 1, 0), ("b", 1, 0), ("c", 1, 0)]
    assert first.versions() == [1, 2, 3]
    third = VersionedTable(spark, path)
    parent = third.manifest(2)
    with pytest.raises(Conflict):
        third._commit(parent, [], spark.range(1).schema, [], 0, None, None)


def test_only_touched_buckets_are_read_and_written(spark):
    table = VersionedTable(spark, scratch_path(spark, "t-manifest"))
    base = spark.range(200).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"), F.lit(0).alias("n"))
    table.upsert(base, ["k"], ["n"], 16)
    before = {f for _, f in table.manifest()["files"]}
    touched = changes(spark, ("5", 2, 1)).select(bucket_of(["k"], 16)).first()[0]
    plan = table._frame(table.manifest(), {touched})._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters: ["):].split("]")[0]
    assert BUCKET in filters and str(touched) in filters
    table.upsert(changes(spark, ("5", 2, 1)), ["k"], ["n"])
    after = {f for _, f in table.manifest()["files"]}
    assert {f.rpartition("/")[0].rpartition("=")[2] for f in before - after} == {str(touched)}
    assert len(after) == len(before) and table.read().where("v = 2").count() == 1


def test_vacuum_keeps_what_versions_and_writers_need(spark):
    path = scratch_path(spark, "t-manifest")
    table = VersionedTable(spark, path)
    for i in range(4):
        table.upsert(changes(spark, (f"k{i}", i, i), ("a", i, i)), ["k"], ["n"], 2)
    with pytest.raises(Killed):
        dying(VersionedTable(spark, path), "_publish").upsert(changes(spark, ("x", 1, 9)), ["k"], ["n"], 2)
    whole = rows(table.read())
    assert table.vacuum(keep=1) == 0                     # all of it is young
    assert table.versions() == [4]
    assert table.vacuum(keep=1, grace_seconds=-5) > 0    # old versions and what the dead writer left
    assert rows(table.read()) == whole and len(whole) == 5


def test_empty_tables_nulls_and_later_batches(spark):
    table = VersionedTable(spark, scratch_path(spark, "t-manifest"))
    with pytest.raises(FileNotFoundError):
        table.read()
    table.upsert(changes(spark).drop("n"), ["k"], buckets=2, writer="w", batch=0)
    assert table.read().count() == 0
    for i in (1, 2):
        table.upsert(changes(spark, (None, i, 0), ("a", i, 0)).drop("n"), ["k"], writer="w", batch=i)
    assert rows(table.read().select("k", "v").fillna("-")) == [("-", 2), ("a", 2)]
    with pytest.raises(ValueError):
        table.upsert(changes(spark, ("a", 1, 1)).drop("n"), ["v"])
