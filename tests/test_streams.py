"""Streams: files in, sink out with availableNow; compared with the batch
query and, for late rows, with a brute-force model of the watermark."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from stackyard.plans import streams_q as SQ
from stackyard.session import scratch_path
from stackyard.streaming import events as EV
from stackyard.sources.manifest import VersionedTable
from stackyard.streaming.sinks import upsert_batch
from stackyard.streaming.state import BUCKETS, ROCKSDB, session_totals
from stackyard.tables import load

SMALL = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_window_equals_batch(spark):
    batch = EV.windowed(load(spark, SMALL, "events"), "ts", "tumbling:1 hour", ["event_type"],
                        [F.count(F.lit(1)).alias("n")])
    src, schema = SQ.event_files(spark, SMALL)
    table = VersionedTable(spark, scratch_path(spark, "t-win"))
    agg = EV.windowed(SQ.read_stream(spark, src, schema), "ts", "tumbling:1 hour", ["event_type"],
                      [F.count(F.lit(1)).alias("n")], delay="1 hour")
    fn = upsert_batch(table, ["window_start", "event_type"], buckets=4)
    SQ.run_available_now(spark, agg.writeStream.foreachBatch(fn).outputMode("update"),
                         scratch_path(spark, "t-win-ckpt"))
    assert _rows(table.read().select(*batch.columns)) == _rows(batch)


def test_dedup_stream_drops_repeats(spark):
    out = SQ.r5_dedup_stream(spark, SMALL)
    ev = load(spark, SMALL, "events")
    assert out.count() == ev.count()
    assert out.select("event_id").distinct().count() == ev.count()


def test_late_rows_follow_the_watermark_model(spark):
    """Brute force, batch by batch: the watermark of a batch is the largest event time of the
    batches before it less one hour; a row is late when its window ended at or before it."""
    folders, _ = SQ.event_days(spark, SMALL, 8, SQ._late_rows)
    kept, late, mark = {}, {}, None
    for folder in folders:
        f = spark.read.parquet(folder).toPandas()
        for ts, kind in zip(f.ts, f.event_type):
            start = ts.floor("h")
            behind = mark is not None and start + pd.Timedelta(hours=1) <= mark
            into = late if behind else kept
            into[(start, kind)] = into.get((start, kind), 0) + 1
        newest = f.ts.max() - pd.Timedelta(hours=1)
        mark = newest if mark is None else max(mark, newest)
    got = SQ.r4_late_rows_dropped(spark, SMALL).collect()
    at = {(pd.Timestamp(r.window_start), r.event_type): (r.n_events, r.n_late) for r in got}
    assert at == {k: (kept.get(k, 0), late.get(k, 0)) for k in {*kept, *late}}
    assert sum(late.values()) > 50 and len(got) == len(at)


def test_late_rows_are_kept_and_replays_change_nothing(spark):
    schema = "ts timestamp_ntz, k string"
    hour = lambda *hs: spark.createDataFrame([((pd.Timestamp("2024-05-01") + pd.Timedelta(hours=h)).to_pydatetime(), "a") for h in hs], schema)
    path = scratch_path(spark, "t-late")
    fn = EV.split_late(path, "ts", ["k"])
    for i, rows in enumerate((hour(1.5), hour(9.5, 8.2, 1.7), hour(2.5, 8.7, 9.9), hour())):
        fn(rows, i)
        fn(rows, i)   # replayed at once
    fn(hour(2.5, 8.7, 9.9), 2)   # and out of order
    counts, late = EV.read_split(spark, path, ["k"])
    assert {(r.window_start.hour, r.n_events, r.n_late) for r in counts.collect()} == {(1, 2, 0), (2, 0, 1), (8, 2, 0), (9, 2, 0)}
    assert [(r.ts.hour, r.k) for r in late.collect()] == [(2, "a")]


def test_sessions_of_sink_and_state_are_all_sessions(spark):
    whole = EV.windowed(load(spark, SMALL, "events"), "ts", "session:30 minutes", ["user_id"],
                        [F.count(F.lit(1)).alias("n_events")])
    assert _rows(SQ.r3_session_window_stream(spark, SMALL)) == _rows(whole)


def test_dedup_state_is_bounded_by_the_watermark(spark):
    src, schema = SQ.event_files(spark, SMALL, extra=SQ._repeats)
    ckpt = scratch_path(spark, "t-dedup-ckpt")
    d = EV.dedup_events(SQ.read_stream(spark, src, schema), "event_id", "ts", delay="1 day")
    SQ.run_available_now(spark, d.writeStream.format("parquet").option("path", scratch_path(spark, "t-dedup"))
                         .outputMode("append"), ckpt)
    held = spark.read.format("statestore").load(ckpt).count()
    assert 0 < held < 0.2 * load(spark, SMALL, "events").count()


def test_event_files_are_in_time_order_and_read_once(spark):
    src, _ = SQ.event_files(spark, SMALL)
    fs, files = SQ._written_files(spark, src)
    last, times = None, []
    for path in files:
        ts = [r.ts for r in spark.read.parquet(path.toString()).collect()]
        assert ts == sorted(ts) and (last is None or not ts or ts[0] >= last)
        last = ts[-1] if ts else last
        times.append(fs.getFileStatus(path).getModificationTime())
    assert times == sorted(times) and len(set(times)) == len(times) > SQ.LEAST_BATCHES


def test_running_state_final_equals_batch(spark):
    out = SQ.r7_running_state(spark, SMALL)
    ev = load(spark, SMALL, "events")
    exp = ev.groupBy(F.col("user_id").alias("key")).agg(F.count(F.lit(1)).alias("n_events"),
                                                        F.max("ts").alias("last_ts"))
    assert _rows(out.select("key", "n_events", "last_ts")) == _rows(exp)


def test_event_time_is_independent_of_session_zone(spark):
    df = load(spark, SMALL, "events").limit(5).select("ts")
    before = _rows(df.select(EV.to_wall_time(EV.to_event_time("ts")).alias("x")))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        after = _rows(df.select(EV.to_wall_time(EV.to_event_time("ts")).alias("x")))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert before == after == _rows(df)


def test_stream_sinks_are_idempotent_under_replay(spark):
    """A micro-batch replayed after a failure must leave the same table."""
    from stackyard.streaming.sinks import append_updates, read_latest
    ev = load(spark, SMALL, "events").select(*SQ.EVENT_COLS)
    first, second = ev.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")), \
        ev.where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    table = VersionedTable(spark, scratch_path(spark, "t-replay"))
    up = upsert_batch(table, ["user_id"], ["ts", "event_id"], buckets=4)
    up(first, 0)
    up(second, 1)
    once = _rows(table.read())
    up(second, 1)      # replay of the last batch
    up(first, 0)       # and of an older one, out of order
    assert _rows(table.read()) == once
    assert len(once) == ev.select("user_id").distinct().count()

    log = VersionedTable(spark, scratch_path(spark, "t-log"))
    counts = lambda df: df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    app = append_updates(log, ["user_id"], compact_every=2)
    app(counts(first), 0)
    app(counts(ev), 1)
    app(counts(ev), 1)  # a replay is known
    assert _rows(read_latest(log, ["user_id"])) == _rows(counts(ev))
    assert log.read().count() == counts(ev).count()   # compacted: one row a key


def _session_totals(spark, rows, label):
    """``session_totals`` of a folder per list of rows, a micro-batch each; (rows of the sink, queries)."""
    root, out, ckpt = (scratch_path(spark, f"{label}-{x}") for x in ("src", "out", "ckpt"))
    schema, queries = "user_id long, ts timestamp_ntz, value double", []
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{root}/{i}")
        totals = session_totals(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(root),
                                "user_id", "ts", "value")
        queries.append(SQ.start_available_now(
            spark, totals.writeStream.format("parquet").option("path", out).outputMode("append"), ckpt, conf=ROCKSDB))
    return spark.read.parquet(out), queries


def test_session_totals_state_does_not_grow_with_the_keys(spark):
    """Each call of the processor reads and writes its state, so there must not be one per key."""
    start, keys = dt.datetime(2024, 5, 1), 3 * BUCKETS
    out, (first, _) = _session_totals(spark, [
        [(k, start + dt.timedelta(minutes=m), 1.0) for k in range(keys) for m in (0, 20, 300)],
        [(-1, start + dt.timedelta(days=2), 0.0)]], "t-keys")
    assert 0 < sum(p["stateOperators"][0]["numRowsUpdated"] for p in first.recentProgress) <= 4 * BUCKETS
    assert out.groupBy("n_events", "total").count().sort("n_events").collect() == [(1, 1.0, keys), (2, 2.0, keys)]
    assert out.select("key").distinct().count() == keys


def test_session_totals_with_null_keys_times_and_values(spark):
    """A null key is a key of its own, an event without a time a session of its own; neither touches other sessions."""
    at = lambda h, m=0: dt.datetime(2024, 5, 1, h, m)
    big = 2 ** 60 + 1   # not a double
    out, _ = _session_totals(spark, [
        [(1, at(1), 1.0), (None, at(1, 10), 2.0), (big, at(1, 5), 4.0), (None, at(1, 30), None), (0, at(1, 5), 8.0),
         (1, None, 16.0), (None, None, None), (1, at(5), 32.0)],
        [(1, at(5, 29), 64.0), (1, at(5, 59), 128.0), (big, None, 1.0), (2, None, 1.0)],
        [(-1, dt.datetime(2024, 5, 3), 0.0)]], "t-nulls")
    want = [(1, at(1), at(1, 30), 1, 1.0), (None, at(1, 10), at(2), 2, 2.0), (big, at(1, 5), at(1, 35), 1, 4.0),
            (0, at(1, 5), at(1, 35), 1, 8.0), (1, None, None, 1, 16.0), (None, None, None, 1, 0.0),
            (1, at(5), at(5, 59), 2, 96.0), (1, at(5, 59), at(6, 29), 1, 128.0), (big, None, None, 1, 1.0),
            (2, None, None, 1, 1.0)]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
