"""Event-time operators that run the same on a batch frame and on a stream
(SURVEY R1-R6, R9).

Event time: the driver's tables use ``timestamp_ntz``, and watermarks need
``timestamp``.  ``to_event_time`` maps the wall clock to the instant it
names in UTC and ``to_wall_time`` maps back, both through epoch
microseconds, so results do not depend on the session time zone.

On a stream, a watermark bounds all state: windows close and their state is
dropped once the watermark passes their end; dedup keys live ``delay`` past
their event time; the interval join keeps each side for ``width + delay``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def to_event_time(ts: str | Column) -> Column:
    """``timestamp_ntz`` wall clock -> ``timestamp`` instant (read as UTC)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.expr(EPOCH_NTZ), c))


def to_wall_time(ts: str | Column) -> Column:
    """``timestamp`` instant -> ``timestamp_ntz`` wall clock in UTC."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.expr(EPOCH_NTZ))


def with_event_time(df: DataFrame, ts: str, delay: str | None = None,
                    out: str = "event_time") -> DataFrame:
    """Add the ``timestamp`` event-time column; on a stream also declare the
    watermark ``delay`` (ignored on a batch frame, where all rows are known)."""
    df = df.withColumn(out, to_event_time(ts))
    if delay is not None and df.isStreaming:
        df = df.withWatermark(out, delay)
    return df


def windowed(df: DataFrame, ts: str, window: Column | str, keys: Sequence[str],
             aggs: Sequence[Column], delay: str | None = "1 hour") -> DataFrame:
    """Aggregate per event-time window and key.

    ``window`` is ``"tumbling:1 hour"``, ``"sliding:1 hour/15 minutes"``,
    ``"session:30 minutes"`` or a Column built on ``event_time``.  The
    output carries ``window_start`` and ``window_end`` as wall-clock
    ``timestamp_ntz``.
    """
    ev = with_event_time(df, ts, delay)
    if isinstance(window, str):
        kind, _, spec = window.partition(":")
        if kind == "tumbling":
            w = F.window("event_time", spec)
        elif kind == "sliding":
            size, slide = spec.split("/")
            w = F.window("event_time", size, slide)
        elif kind == "session":
            w = F.session_window("event_time", spec)
        else:
            raise ValueError(f"unknown window {window!r}")
    else:
        w = window
    out = ev.groupBy(w.alias("w"), *keys).agg(*aggs)
    return out.select(to_wall_time("w.start").alias("window_start"),
                      to_wall_time("w.end").alias("window_end"),
                      *keys, *[c for c in out.columns if c not in ("w", *keys)])


def dedup_events(df: DataFrame, id_col: str, ts: str, delay: str = "1 day") -> DataFrame:
    """Each ``id`` once.  On a stream, ids are remembered until the
    watermark passes their event time plus ``delay``
    (``dropDuplicatesWithinWatermark``), so state stays bounded; a batch
    frame keeps one row per id."""
    if df.isStreaming:
        ev = df.withColumn("_et", to_event_time(ts)).withWatermark("_et", delay)
        return ev.dropDuplicatesWithinWatermark([id_col]).drop("_et")
    return df.dropDuplicates([id_col])


def split_late(path: str, ts: str, keys: Sequence[str], window: str = "1 hour",
               delay: str = "1 hour") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that counts each micro-batch's rows per window and key, rows
    on time and late ones apart, and keeps the late rows themselves.

    The watermark of a batch is the largest event time of the batches before it,
    less ``delay``; a row is late when its window ended at or before it.  Spark's own
    stateful operators drop such rows unseen.  The largest event time of a batch is
    written with its counts, in one folder per batch, so a replayed batch
    sees the same watermark and rewrites its own folders.  Read with ``read_split``.
    """
    counts, late_rows = f"{path.rstrip('/')}/counts", f"{path.rstrip('/')}/late"

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = None
        if batch_id > 0 and (done := _batches(spark, counts, batch_id)):
            # as text, so that the driver's own time zone plays no part
            mark = spark.read.parquet(*done).agg(
                (F.max("max_ts") - F.expr(f"INTERVAL {delay}")).cast("string")).first()[0]
        start = F.window(F.col(ts), window)["start"]
        rows = batch.withColumn("window_start", start)
        end = F.col("window_start") + F.expr(f"INTERVAL {window}")
        is_late = F.lit(False) if mark is None else F.coalesce(
            end <= F.lit(mark).cast(batch.schema[ts].dataType), F.lit(False))
        rows = rows.withColumn("_late", is_late).persist()
        try:
            (rows.groupBy("window_start", end.alias("window_end"), *keys).agg(
                F.count(F.when(~F.col("_late"), 1)).alias("n_events"), F.count(F.when(F.col("_late"), 1)).alias("n_late"),
                F.max(ts).alias("max_ts")).write.mode("overwrite").parquet(f"{counts}/{batch_id:012d}"))
            (rows.where("_late").drop("_late", "window_start").write.mode("overwrite")
             .parquet(f"{late_rows}/{batch_id:012d}"))
        finally:
            rows.unpersist()
    return apply


def _batches(spark: SparkSession, folder: str, before: int | None = None) -> list[str]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return [f"{folder}/{n}" for n in sorted(names) if n.isdigit() and (before is None or int(n) < before)]


def read_split(spark: SparkSession, path: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """What ``split_late`` wrote: counts per window and key (all windows, the last ones too), and the late rows."""
    root = path.rstrip("/")
    counts = spark.read.parquet(*_batches(spark, f"{root}/counts")).groupBy("window_start", "window_end", *keys).agg(
        F.sum("n_events").alias("n_events"), F.sum("n_late").alias("n_late"))
    return counts, spark.read.parquet(*_batches(spark, f"{root}/late"))


def open_sessions(spark: SparkSession, checkpoint: str, keys: Sequence[str], aggs: Sequence[str]) -> DataFrame:
    """The sessions that a stopped session-window stream still holds, read from its state.

    ``aggs`` names the aggregates in their order; each must be one whose state is its
    result (count, sum, min, max).  Together with what the sink has, these are all sessions
    of the input.
    """
    state = spark.read.format("statestore").load(checkpoint).select("value.*")
    held = [c for c in state.columns if c not in ("session_window", *keys)]
    return state.select(to_wall_time("session_window.start").alias("window_start"),
                        to_wall_time("session_window.end").alias("window_end"), *keys,
                        *[F.col(c).alias(a) for c, a in zip(held, aggs, strict=True)])


def enrich(stream: DataFrame, static: DataFrame, on, how: str = "left") -> DataFrame:
    """Stream-static join.  Spark broadcasts the static side when its bytes
    are under the threshold and shuffles both sides otherwise."""
    return stream.join(static, on, how)


_UNIT_US = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000,
            "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def interval_micros(spec: str) -> int:
    """``"90 minutes"`` -> microseconds (single-unit interval strings)."""
    n, unit = spec.split()
    return int(n) * _UNIT_US[unit.lower().rstrip("s")]


def interval_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str,
                  width: str = "1 hour", delay: str = "1 hour",
                  how: str = "inner") -> DataFrame:
    """Pairs with equal ``key`` where ``right_ts`` falls in
    ``[left_ts, left_ts + width]``.

    A plain equi join on the key would compare every left row of a key with
    every right row of it before applying the time bound: quadratic in a hot
    key.  The join key therefore also carries a time bucket of size
    ``width``: a right row is offered to its own bucket and the one before,
    which are exactly the left buckets that can match it, so each pair is
    found once and a key only meets rows one window apart.  On streams both
    sides carry watermarks and state is evicted after ``width + delay``.
    """
    if how not in ("inner", "left", "left_outer", "leftouter"):
        # a right row is offered to two buckets, so it cannot be told unmatched once
        raise ValueError("interval_join is inner or left")
    w_us = interval_micros(width)
    lt = with_event_time(left, left_ts, delay, "_l_et")
    lt = lt.withColumn("_l_b", F.floor(F.unix_micros("_l_et") / F.lit(w_us)))
    rt = with_event_time(right, right_ts, delay, "_r_et").withColumnRenamed(key, "_r_key")
    rb = F.floor(F.unix_micros("_r_et") / F.lit(w_us))
    rt = rt.withColumn("_r_b", F.explode(F.array(rb, rb - 1)))
    cond = ((lt[key] == rt["_r_key"]) & (lt["_l_b"] == rt["_r_b"])
            & (rt["_r_et"] >= lt["_l_et"])
            & (rt["_r_et"] <= lt["_l_et"] + F.expr(f"INTERVAL {width}")))
    return lt.join(rt, cond, how).drop("_l_et", "_r_et", "_r_key", "_l_b", "_r_b")
