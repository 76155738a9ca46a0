"""Inputs outside the driver's tables: nulls, ties, white space, line breaks, empty increments."""

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SMALL
from stackyard.functions import strings as S
from stackyard.operators import catalog, ordinal, updates
from stackyard.operators.asof import asof_join
from stackyard.operators.ranges import range_totals
from stackyard.sources import jdbc, text, topic, xml
from stackyard.streaming.events import interval_join


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()["y"]


def test_white_space_other_than_blanks_is_stripped(spark):
    assert one(spark, "alpha beta\n", S.last_ws_field("x")) == "beta"
    assert one(spark, "\talpha beta", S.nth_ws_field("x", 1)) == "alpha"
    assert one(spark, "\t a  b\n", S.collapse_ws("x")) == "a b"


def test_import_since_keeps_the_mark_of_an_empty_increment(spark):
    src = spark.createDataFrame([(1,), (5,)], "id bigint")
    rows, mark = jdbc.import_since(src, "id", 5)
    assert rows.count() == 0 and mark.first()[0] == 5
    assert jdbc.import_since(src, "id", None)[1].first()[0] == 5
    assert jdbc.import_since(src.limit(0), "id", None)[1].first()[0] is None


def test_exact_avg_of_large_and_negative_sums(spark):
    frame = spark.createDataFrame([(5e12, 3), (-1.0, 3), (0.05, 2), (0.0, 4)], "s double, n bigint")
    got = [r[0] for r in frame.select(S.exact_avg("s", "n")).collect()]
    assert got == [1666666666666.666667, -0.333333, 0.025, 0.0]


def test_delimited_keeps_empty_fields(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a,,c\nd  e f\n")
    rows, _ = text.read_delimited(spark, str(tmp_path / "a.txt"), ["p", "q", "r"], sep=",")
    assert ("a", "", "c") in [tuple(r)[:3] for r in rows.collect()]
    rows, _ = text.read_delimited(spark, str(tmp_path / "a.txt"), ["p", "q", "r"])
    assert ("d", "e", "f") in [tuple(r)[:3] for r in rows.collect()]


@pytest.mark.parametrize("codec", ["none", "gzip"])
def test_line_breaks_survive_text_files(spark, tmp_path, codec):
    values = ["a\nb", "a\\nb", "c\r\nd", "back\\slash", "plain", "\\\\n", "nul\x00 in", "\\\n\\", "\\\\\r\\n"]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    text.write_text(frame, str(tmp_path / "t"), codec)
    back = text.read_text(spark, str(tmp_path / "t"), "i int, v string")
    assert [r.v for r in back.orderBy("i").collect()] == values


def test_topic_values_of_another_shape_are_rejects(spark):
    values = ["5", "[1]", '{"event_id":"abc"}', '{"event_id":7}', "{", None, '[{"event_id":1}]']
    frame = spark.createDataFrame([(v,) for v in values], "v string").select(
        F.col("v").cast("binary").alias("value"), F.lit("t").alias("topic"), F.lit(0).alias("partition"))
    good, bad = topic.decode_topic(frame, "event_id bigint")
    assert [r.event_id for r in good.collect()] == [7]
    assert bad.count() == len(values) - 1


def test_upsert_of_a_null_key_is_idempotent(spark):
    base = spark.createDataFrame([(None, "old"), (1, "a")], "k int, v string")
    new = spark.createDataFrame([(None, "new", 1)], "k int, v string, o int")
    once = updates.upsert(base, new, ["k"], ["o"])
    twice = updates.upsert(once, new, ["k"], ["o"])
    assert sorted(map(str, map(tuple, twice.collect()))) == ["(1, 'a')", "(None, 'new')"]


def test_overlay_takes_the_last_of_repeated_names(spark):
    base = spark.createDataFrame([("a", "0"), ("b", "1")], "name string, value string")
    extra = spark.createDataFrame([("a", "9", 1), ("a", "2", 2)], "name string, value string, pos int")
    got = xml.overlay(base, extra, replace=True, order="pos").select("name", "value").collect()
    assert sorted(map(tuple, got)) == [("a", "2"), ("b", "1")]


def test_statements_with_comments_and_escapes():
    script = "SELECT 1 /* a;b */; SELECT 'it\\'s; fine' -- x;y\n; SELECT `a;b`"
    assert catalog.split_statements(script) == ["SELECT 1", "SELECT 'it\\'s; fine'", "SELECT `a;b`"]


def test_interval_join_refuses_what_it_cannot_do(spark):
    frame = spark.createDataFrame([], "k int, t timestamp")
    with pytest.raises(ValueError):
        interval_join(frame, frame, "k", "t", "t", how="right")


def test_asof_matches_no_nulls(spark):
    left = spark.createDataFrame([(None, 5.0, "a"), (1, None, "b"), (1, 5.0, "c"), (1, 2.0, "d")],
                                 "k int, t double, id string")
    right = spark.createDataFrame([(None, 1.0, 10), (1, None, 11), (1, 2.0, 12), (1, 5.0, 13)],
                                  "k int, rt double, v int")
    for n in (1, 3):
        got = {r.id: r.v for r in asof_join(left, right, "k", "t", "rt", ["v"], partitions=n).collect()}
        assert got == {"a": None, "b": None, "c": 13, "d": 12}
        got = {r.id: r.v for r in asof_join(left, right, "k", "t", "rt", ["v"], partitions=n,
                                            strict=True).collect()}
        assert got == {"a": None, "b": None, "c": 12, "d": None}


def test_running_sums_keep_type_and_null(spark):
    rows = [("n", 1, None), ("n", 2, None), ("b", 1, 9007199254740993), ("b", 2, None), ("b", 3, 4)]
    frame = spark.createDataFrame(rows, "k string, o int, v bigint")
    for n in (1, 4):
        got = {(r.k, r.o): r.s for r in
               ordinal.running_sum(frame, ["k"], ["o"], "v", out="s", partitions=n).collect()}
        assert got == {("n", 1): None, ("n", 2): None, ("b", 1): 9007199254740993,
                       ("b", 2): 9007199254740993, ("b", 3): 9007199254740997}


NULL_KEY = "SELECT event_id, nullif(user_id % 7, 0) AS k, ts, value FROM events"


def test_ranks_and_lags_keep_null_keys(spark):
    ev = spark.read.parquet(f"{SMALL}/events.parquet").select(
        "event_id", F.expr("nullif(user_id % 7, 0)").alias("k"), "ts", "value")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SMALL}/events.parquet'")
    expected = con.execute(f"""
        SELECT event_id, row_number() OVER (PARTITION BY k ORDER BY value DESC, event_id),
               rank() OVER (PARTITION BY k ORDER BY value DESC),
               ntile(4) OVER (PARTITION BY k ORDER BY value DESC, event_id),
               lag(event_id) OVER (PARTITION BY k ORDER BY ts, event_id) FROM ({NULL_KEY})""").fetchall()
    r = ordinal.ranks(ev, ["k"], "value", "event_id", tiles=4, partitions=8)
    lag = ordinal.shifted(ev, ["k"], ["ts", "event_id"], ["event_id"], 1, partitions=8)
    got = r.join(lag.select("event_id", "lag_event_id"), "event_id").select(
        "event_id", "row_number", "rank", "ntile", "lag_event_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_slices_of_equal_values_and_any_number(spark):
    frame = spark.range(20_000).select("id", (F.col("id") % 3).alias("v"), F.lit("k").alias("k"))
    for n, most in ((16, 3), (2000, 10)):
        sizes = ordinal.with_slice(frame, [("k", False), ("v", False)], n).groupBy("_rp").count()
        row = sizes.agg(F.count("*").alias("slices"), F.max("count").alias("largest")).first()
        assert row.slices > n / 2 and row.largest <= most * 20_000 / n
    text_desc = frame.withColumn("t", F.col("id").cast("string"))
    got = ordinal.ordinal(text_desc, ["k"], [ordinal.desc("t")], partitions=100).orderBy("ordinal")
    assert [r.t for r in got.select("t").limit(3).collect()] == ["9999", "9998", "9997"]


def test_sums_between_without_pairs(spark):
    steps = spark.createDataFrame([("a", float(i), 1 if i else None) for i in range(50)], "k string, at double, v bigint")
    ends = spark.createDataFrame([("a", 9.5, 20.0), ("a", -5.0, 3.0), ("a", -5.0, -1.0), (None, 0.0, 9.0), ("b", 0.0, 9.0),
                                  ("a", None, 5.0), ("a", 7.0, 3.0), ("a", 0.0, 0.0)], "k string, lo double, hi double")
    got = range_totals(ends, steps, "k", "lo", "hi", "at", "v", partitions=4).collect()
    assert {(r.k, r.lo, r.hi): (r.n, r.total) for r in got} == {
        ("a", 9.5, 20.0): (11, 11), ("a", -5.0, 3.0): (4, 3), ("a", -5.0, -1.0): (0, None), (None, 0.0, 9.0): (0, None),
        ("b", 0.0, 9.0): (0, None), ("a", None, 5.0): (0, None), ("a", 7.0, 3.0): (0, None), ("a", 0.0, 0.0): (1, None)}


def test_a_dataset_is_replaced_under_its_own_path(spark, tmp_path):
    from stackyard.sources.sinks import replace_table
    path = str(tmp_path / "t")
    table = replace_table(spark, spark.range(5), path)
    before = table.read()
    assert replace_table(spark, before.where("id > 2"), path).versions() == [1, 2]
    assert sorted(r.id for r in table.read().collect()) == [3, 4]
    assert sorted(r.id for r in before.collect()) == [0, 1, 2, 3, 4]   # an open reader keeps its version
    assert sorted(r.id for r in table.read(version=1).collect()) == [0, 1, 2, 3, 4]
