"""Streams (IO11, R1-R9).

Stream runs read files cut from ``events`` in time order (as many files per
micro-batch as the session has shuffle partitions), run with ``availableNow`` and a
checkpoint under the shared folder, and return what the sink wrote.  The late-row
query (R4) takes one folder of days per micro-batch, so that SQL knows the batches.
"""

import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackyard.functions.strings import exact_avg
from stackyard.operators.sessions import sessionize
from stackyard.plans.registry import query
from stackyard.session import scratch_path
from stackyard.sources.manifest import VersionedTable
from stackyard.streaming import events as EV
from stackyard.streaming.sinks import append_updates, ingest_logs, read_latest, start_available_now, upsert_batch
from stackyard.streaming.state import ROCKSDB, running_state, running_totals, session_totals
from stackyard.tables import load

LEAST_BATCHES, ROWS_PER_FILE = 4, 1_000_000
JSON_TIME = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
EVENT_COLS = ["event_id", "ts", "user_id", "event_type", "value"]


def files_per_batch(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _written_files(spark, root):
    """``(file system, path)`` of the data files under ``root``, by name."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, sorted((s.getPath() for s in fs.listStatus(at) if s.getPath().getName()[0] not in "._"),
                      key=lambda p: p.getName())


def event_files(spark, sf, extra=None, fmt="parquet"):
    """Write ``events`` in time order (plus ``extra`` rows as later files); return (folder, schema).

    One range-partitioned write, whatever the number of files: the names follow the
    time, a range of many rows is cut into several files.  The file source takes files
    in the order of their modification times, which are set accordingly.
    """
    root = scratch_path(spark, "events-src")
    ev = load(spark, sf, "events").select(*EVENT_COLS)

    def put(df):
        w = df.write.mode("append").option("maxRecordsPerFile", str(ROWS_PER_FILE))
        (w.options(**JSON_TIME).json(root) if fmt == "json" else w.parquet(root))

    put(ev.repartitionByRange(LEAST_BATCHES * files_per_batch(spark), "ts").sortWithinPartitions("ts"))
    fs, files = _written_files(spark, root)
    first = int(time.time() * 1000) - 1000 * (len(files) + 1)
    for i, path in enumerate(files):
        fs.setTimes(path, first + 1000 * i, -1)
    if extra is not None:
        put(extra(ev).repartition(files_per_batch(spark)))
    return root, ev.schema


def event_days(spark, sf, days, extra):
    """Write ``events`` once, so many days to a folder, and ``extra`` rows to a last one; return (folders, schema)."""
    root = scratch_path(spark, "events-days")
    ev = load(spark, sf, "events").select(*EVENT_COLS)
    batch = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / F.lit(days)).cast("int")
    late = extra(ev).withColumn("batch", F.lit(LAST_BATCH))
    ev.withColumn("batch", batch).unionByName(late).write.partitionBy("batch").parquet(root)
    _, folders = _written_files(spark, root)
    return (sorted((p.toString() for p in folders), key=lambda p: int(p.rpartition("=")[2])),
            T.StructType([*ev.schema.fields, T.StructField("batch", T.IntegerType())]))


LAST_BATCH = 1_000_000


def read_stream(spark, root, schema, fmt="parquet"):
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_batch(spark)))
    return r.options(**JSON_TIME).json(root) if fmt == "json" else r.parquet(root)


def run_available_now(spark, writer, ckpt):
    return start_available_now(spark, writer, ckpt)


@query("io11_ingest_logs", "IO11", sql="""
SELECT event_id, ts, user_id, event_type, value FROM events
""")
def io11_ingest_logs(spark, sf):
    src, schema = event_files(spark, sf, fmt="json")
    out, ckpt = scratch_path(spark, "io11-out"), scratch_path(spark, "io11-ckpt")
    q = ingest_logs(spark, src, schema, out, ckpt, fmt="json", max_files_per_trigger=files_per_batch(spark),
                    options=JSON_TIME)
    q.awaitTermination()
    return spark.read.parquet(out)


HOURLY_AGGS = lambda: [F.count(F.lit(1)).alias("n_events"),
                       F.round(F.sum("value"), 2).alias("value_sum")]


@query("r1_tumbling_count", "R1", sql="""
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
       event_type, COUNT(*) AS n_events, round(SUM(value), 2) AS value_sum
FROM events GROUP BY 1, 2, 3
""")
def r1_tumbling_count(spark, sf):
    return EV.windowed(load(spark, sf, "events"), "ts", "tumbling:1 hour", ["event_type"],
                       HOURLY_AGGS())


@query("r1_tumbling_count_stream", "R1", sql="""
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
       event_type, COUNT(*) AS n_events, round(SUM(value), 2) AS value_sum
FROM events GROUP BY 1, 2, 3
""")
def r1_tumbling_count_stream(spark, sf):
    src, schema = event_files(spark, sf)
    log = VersionedTable(spark, scratch_path(spark, "r1-log"))
    agg = EV.windowed(read_stream(spark, src, schema), "ts", "tumbling:1 hour", ["event_type"],
                      HOURLY_AGGS(), delay="1 hour")
    # update mode: each batch emits the windows it changed; window state is
    # dropped once the watermark passes; the newest version per window wins
    run_available_now(spark, agg.writeStream.foreachBatch(
        append_updates(log, ["window_start", "event_type"])).outputMode("update"), scratch_path(spark, "r1-ckpt"))
    return read_latest(log, ["window_start", "event_type"]).select(
        "window_start", "window_end", "event_type", "n_events", "value_sum")


@query("r2_sliding_avg", "R2", sql="""
WITH b AS (SELECT event_type, value,
                  time_bucket(INTERVAL '15 minutes', ts) - k * INTERVAL '15 minutes' AS ws
           FROM events, (SELECT unnest(generate_series(0, 3)) AS k))
SELECT ws AS window_start, ws + INTERVAL 1 HOUR AS window_end, event_type,
       COUNT(*) AS n_events,
       floor((2 * CAST(round(SUM(value) * 100) AS BIGINT) * 10000 + COUNT(*)) / (2 * COUNT(*)))
         / 1000000 AS value_avg
FROM b GROUP BY 1, 2, 3
""")
def r2_sliding_avg(spark, sf):
    w = EV.windowed(load(spark, sf, "events"), "ts", "sliding:1 hour/15 minutes", ["event_type"],
                    [F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("_sum")])
    # average rounded half up to 6 decimals exactly (values have 2 decimals)
    return w.withColumn("value_avg", exact_avg("_sum", "n_events")).drop("_sum")


@query("r3_session_window", "R3", sql="""
WITH g AS (SELECT user_id, ts,
                  CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
                         OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
                                  + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk,
                  event_id
           FROM events),
     s AS (SELECT user_id, ts, SUM(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid
           FROM g)
SELECT MIN(ts) AS window_start, MAX(ts) + INTERVAL 30 MINUTE AS window_end, user_id,
       COUNT(*) AS n_events
FROM s GROUP BY user_id, sid
""")
def r3_session_window(spark, sf):
    # batch: gaps and islands on skew-safe positions (a hot user is spread
    # over many tasks); the stream form is EV.windowed(..., "session:...")
    return sessionize(load(spark, sf, "events"), "user_id", "ts", "30 minutes", "event_id",
                      [F.count(F.lit(1)).alias("n_events")])


@query("r3_session_window_stream", "R3", sql="""
WITH g AS (SELECT user_id, ts,
                  CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
                         OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
                                  + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk,
                  event_id
           FROM events),
     s AS (SELECT user_id, ts, SUM(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid
           FROM g)
SELECT MIN(ts) AS window_start, MAX(ts) + INTERVAL 30 MINUTE AS window_end, user_id,
       COUNT(*) AS n_events
FROM s GROUP BY user_id, sid
""")
def r3_session_window_stream(spark, sf):
    src, schema = event_files(spark, sf)
    sess = EV.windowed(read_stream(spark, src, schema), "ts", "session:30 minutes", ["user_id"],
                       [F.count(F.lit(1)).alias("n_events")], delay="1 hour")
    # append mode: a session is written once, when the watermark (max event
    # time minus one hour) passes its end; at the end of the input the others are read from the state
    out, ckpt = scratch_path(spark, "r3-out"), scratch_path(spark, "r3-ckpt")
    run_available_now(spark, sess.writeStream.format("parquet").option("path", out)
                      .outputMode("append"), ckpt)
    return spark.read.parquet(out).unionByName(EV.open_sessions(spark, ckpt, ["user_id"], ["n_events"]))


def _late_rows(ev):
    """Derived late rows: every tenth event re-sent three hours back in time."""
    return (ev.where(F.col("event_id") % 10 == 0)
            .withColumn("ts", F.col("ts") - F.expr("INTERVAL 3 HOURS")))


@query("r4_late_rows_dropped", "R4", sql="""
WITH e AS (SELECT ts, event_type, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 8 AS batch FROM events
           UNION ALL SELECT ts - INTERVAL 3 HOUR, event_type, 1000000 FROM events WHERE event_id % 10 = 0),
m AS (SELECT batch, MAX(MAX(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
               - INTERVAL 1 HOUR AS mark FROM e GROUP BY batch),
l AS (SELECT date_trunc('hour', ts) AS ws, event_type,
             coalesce(date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark, false) AS late FROM e JOIN m USING (batch))
SELECT ws AS window_start, ws + INTERVAL 1 HOUR AS window_end, event_type,
       COUNT(*) FILTER (NOT late) AS n_events, COUNT(*) FILTER (late) AS n_late FROM l GROUP BY ws, event_type
""")
def r4_late_rows_dropped(spark, sf):
    """Hourly counts of a stream whose last folder re-sends rows three hours
    late; rows behind the watermark (1 hour) are counted apart."""
    folders, schema = event_days(spark, sf, 8, _late_rows)
    out, ckpt = scratch_path(spark, "r4-out"), scratch_path(spark, "r4-ckpt")
    for folder in folders:   # a run per folder, as new days arrive
        # as a pattern, since for a plain folder the file source sets the base path to the folder itself
        rows = spark.readStream.schema(schema).option("basePath", folder.rpartition("/")[0]).parquet(
            f"{folder[:-1]}[{folder[-1]}]").drop("batch")
        run_available_now(spark, rows.writeStream.foreachBatch(EV.split_late(out, "ts", ["event_type"])), ckpt)
    return EV.read_split(spark, out, ["event_type"])[0]


def _repeats(ev):
    """Derived repeats: every twentieth event sent again in a later file, most of them long after
    the watermark has passed (dropped as late), those of the last day within it (known ids)."""
    return ev.where(F.col("event_id") % 20 == 0)


@query("r5_dedup_stream", "R5", sql="""
SELECT event_id, ts, user_id, event_type, value FROM events
""")
def r5_dedup_stream(spark, sf):
    src, schema = event_files(spark, sf, extra=_repeats)
    out = scratch_path(spark, "r5-out")
    d = EV.dedup_events(read_stream(spark, src, schema), "event_id", "ts", delay="1 day")
    run_available_now(spark, d.writeStream.format("parquet").option("path", out).outputMode("append"),
                      scratch_path(spark, "r5-ckpt"))
    return spark.read.parquet(out)


@query("r6_enrich", "R6", sql="""
SELECT event_id, event_type, c_name, c_mktsegment
FROM events LEFT JOIN customer ON user_id = c_custkey
""")
def r6_enrich(spark, sf):
    ev = load(spark, sf, "events").select("event_id", "event_type", "user_id")
    cust = load(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name",
                                              "c_mktsegment")
    return EV.enrich(ev, cust, "user_id", "left").drop("user_id")


@query("r6_enrich_stream", "R6", sql="""
SELECT event_id, event_type, c_name, c_mktsegment
FROM events LEFT JOIN customer ON user_id = c_custkey
""")
def r6_enrich_stream(spark, sf):
    src, schema = event_files(spark, sf)
    cust = load(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name",
                                              "c_mktsegment")
    s = read_stream(spark, src, schema).select("event_id", "event_type", "user_id")
    out = scratch_path(spark, "r6-out")
    run_available_now(spark, EV.enrich(s, cust, "user_id", "left").drop("user_id").writeStream
                      .format("parquet").option("path", out).outputMode("append"),
                      scratch_path(spark, "r6-ckpt"))
    return spark.read.parquet(out)


@query("r7_running_state", "R7", sql="""
SELECT user_id AS key, COUNT(*) AS n_events, round(SUM(value), 2) AS value_sum,
       arg_max(event_id, (ts, event_id)) AS last_event_id, MAX(ts) AS last_ts
FROM events GROUP BY user_id
""")
def r7_running_state(spark, sf):
    src, schema = event_files(spark, sf)
    log = VersionedTable(spark, scratch_path(spark, "r7-log"))
    st = running_state(read_stream(spark, src, schema), "user_id", "ts", "event_id", "value")
    run_available_now(spark, st.writeStream.foreachBatch(append_updates(log, ["key"])).outputMode("update"),
                      scratch_path(spark, "r7-ckpt"))
    return read_latest(log, ["key"]).withColumn("value_sum", F.round("value_sum", 2))


@query("r7_running_totals", "R7", sql="""
SELECT user_id AS key, COUNT(*) AS n_events, round(SUM(value), 2) AS value_sum,
       arg_max(event_id, (ts, event_id)) AS last_event_id, MAX(ts) AS last_ts
FROM events GROUP BY user_id
""")
def r7_running_totals(spark, sf):
    src, schema = event_files(spark, sf)
    log = VersionedTable(spark, scratch_path(spark, "r7t-log"))
    totals = running_totals(read_stream(spark, src, schema), "user_id", "ts", "event_id", "value")
    # update mode: changed keys per batch; the newest version per key wins
    run_available_now(spark, totals.writeStream.foreachBatch(append_updates(log, ["key"])).outputMode("update"),
                      scratch_path(spark, "r7t-ckpt"))
    return read_latest(log, ["key"]).withColumn("value_sum", F.round("value_sum", 2))


def _heartbeat(ev):
    """Derived: one event of no user, two days after the last one; it moves the watermark past all sessions."""
    last = ev.agg(F.max("ts").alias("ts"))
    return last.select(F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"),
                       F.lit(-1).cast("long").alias("user_id"), F.lit("heartbeat").alias("event_type"),
                       F.lit(0.0).alias("value"))


@query("r7_session_totals", "R7", sql="""
WITH g AS (SELECT user_id, ts, value, event_id,
                  CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE
                       THEN 0 ELSE 1 END AS brk
           FROM events),
     s AS (SELECT *, SUM(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
SELECT user_id AS key, MIN(ts) AS window_start, MAX(ts) + INTERVAL 30 MINUTE AS window_end,
       COUNT(*) AS n_events, round(SUM(value), 2) AS total
FROM s GROUP BY user_id, sid
""")
def r7_session_totals(spark, sf):
    src, schema = event_files(spark, sf, extra=_heartbeat)
    out = scratch_path(spark, "r7s-out")
    totals = session_totals(read_stream(spark, src, schema), "user_id", "ts", "value")
    start_available_now(spark, totals.writeStream.format("parquet").option("path", out).outputMode("append"),
                        scratch_path(spark, "r7s-ckpt"), conf=ROCKSDB)
    return spark.read.parquet(out).withColumn("total", F.round("total", 2))


@query("r8_stream_upsert", "R8", sql="""
SELECT user_id, event_id, ts, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1
""")
def r8_stream_upsert(spark, sf):
    src, schema = event_files(spark, sf)
    table = VersionedTable(spark, scratch_path(spark, "r8-table"))
    fn = upsert_batch(table, ["user_id"], ["ts", "event_id"], buckets=files_per_batch(spark))
    run_available_now(spark, read_stream(spark, src, schema).writeStream.foreachBatch(fn),
                      scratch_path(spark, "r8-ckpt"))
    return table.read().select(*EVENT_COLS)


@query("r9_interval_join", "R9", sql="""
SELECT v.user_id, v.event_id AS view_id, p.event_id AS purchase_id
FROM events v JOIN events p
  ON v.user_id = p.user_id AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 1 HOUR
WHERE v.event_type = 'view' AND p.event_type = 'purchase'
""")
def r9_interval_join(spark, sf):
    ev = load(spark, sf, "events")
    views = ev.where(F.col("event_type") == "view").select("user_id", F.col("event_id").alias("view_id"),
                                                          F.col("ts").alias("view_ts"))
    buys = ev.where(F.col("event_type") == "purchase").select(
        "user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("buy_ts"))
    j = EV.interval_join(views, buys, "user_id", "view_ts", "buy_ts", "1 hour")
    return j.select("user_id", "view_id", "purchase_id")


@query("r9_interval_join_stream", "R9", sql="""
SELECT v.user_id, v.event_id AS view_id, p.event_id AS purchase_id
FROM events v JOIN events p
  ON v.user_id = p.user_id AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 1 HOUR
WHERE v.event_type = 'view' AND p.event_type = 'purchase'
""")
def r9_interval_join_stream(spark, sf):
    src, schema = event_files(spark, sf)
    s = read_stream(spark, src, schema)
    views = s.where(F.col("event_type") == "view").select(
        "user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"))
    buys = s.where(F.col("event_type") == "purchase").select(
        "user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("buy_ts"))
    j = EV.interval_join(views, buys, "user_id", "view_ts", "buy_ts", "1 hour", delay="2 hours")
    out = scratch_path(spark, "r9-out")
    run_available_now(spark, j.select("user_id", "view_id", "purchase_id").writeStream.format("parquet")
                      .option("path", out).outputMode("append"), scratch_path(spark, "r9-ckpt"))
    return spark.read.parquet(out)
