"""Keyed running state.

``session_totals`` is state with timers (``transformWithState``): a session's
total leaves when the watermark passes its end.

``running_totals`` is the built-in form: a streaming aggregation in update
mode, combined map-side before the shuffle, so a hot key in a micro-batch
ships one buffer per task; use it whenever the state is an aggregate.
``running_state`` is the custom form with ``applyInPandasWithState``, for
state logic that no aggregate expresses.

For ``running_state``, Spark groups the stream by key and hands each key's new rows of a
micro-batch to the function together with that key's state; the state is
checkpointed with the query, so a lost executor replays from the last
commit.  Only a fixed-size summary is stored per key (count, sum, last
time), never the key's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from stackyard.streaming.events import interval_micros, to_wall_time, with_event_time

OUTPUT_SCHEMA = "key long, n_events long, value_sum double, last_event_id long, last_us long"
STATE_SCHEMA = "n long, s double, last_id long, last_us long"


def _update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    n, s, last_id, last_us = state.get if state.exists else (0, 0.0, None, None)
    for pdf in batches:
        if pdf.empty:
            continue
        n += len(pdf)
        s += float(pdf["value"].sum())
        us = pdf["_us"].to_numpy()
        ids = pdf["_id"].to_numpy()
        i = np.lexsort((ids, us))[-1]
        if last_us is None or (us[i], ids[i]) > (last_us, last_id):
            last_us, last_id = int(us[i]), int(ids[i])
    state.update((n, s, last_id, last_us))
    yield pd.DataFrame({"key": [key[0]], "n_events": [n], "value_sum": [s],
                        "last_event_id": [last_id], "last_us": [last_us]})


def running_state(df: DataFrame, key: str, ts: str, id_col: str, value: str) -> DataFrame:
    """Per key: running event count, value sum and latest event, emitted
    for every key that received rows in a micro-batch (update mode)."""
    prepared = df.select(F.col(key).cast("long").alias("_k"),
                         F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"),
                                          F.col(ts)).alias("_us"),
                         F.col(id_col).cast("long").alias("_id"),
                         F.col(value).cast("double").alias("value"))
    out = prepared.groupBy("_k").applyInPandasWithState(
        _update, OUTPUT_SCHEMA,
        STATE_SCHEMA, "update", GroupStateTimeout.NoTimeout)
    return out.select("key", "n_events", "value_sum", "last_event_id",
                      F.timestamp_add("MICROSECOND", F.col("last_us"),
                                      F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")).alias("last_ts"))


def running_totals(df: DataFrame, key: str, ts: str, id_col: str, value: str) -> DataFrame:
    """Per key: event count, value sum and latest event, as a built-in
    streaming (or batch) aggregation; emitted per micro-batch for the keys
    that changed (update mode)."""
    last = F.max_by(F.struct(F.col(id_col).cast("long").alias("e"), F.col(ts).alias("t")),
                    F.struct(F.col(ts), F.col(id_col)))
    agg = df.groupBy(F.col(key).cast("long").alias("key")).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(F.col(value).cast("double")).alias("value_sum"),
        last.alias("_last"))
    return agg.select("key", "n_events", "value_sum", F.col("_last.e").alias("last_event_id"),
                      F.col("_last.t").alias("last_ts"))


ROCKSDB = {"spark.sql.streaming.stateStore.providerClass":
           "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
SESSIONS = "key long, start_us long, end_us long, n_events long, total double"
#: An open session: key (and whether it is null), first and last event in microseconds, events, total.
SPAN = np.dtype([("null", "i8"), ("key", "i8"), ("start", "i8"), ("last", "i8"), ("n", "i8"), ("total", "f8")])
NO_TIME = -2**63
BUCKETS = 1024


class _Sessions(StatefulProcessor):
    """The open sessions of one bucket of keys, in one value; they leave by a timer at the end of the first of them."""

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "spans binary")

    def _held(self) -> np.ndarray:
        value = self.open.get()
        return np.frombuffer(value[0] if value else b"", SPAN)

    def _hold(self, spans: np.ndarray) -> None:
        if not len(spans):
            self.open.clear()
            return
        self.open.update((spans.tobytes(),))
        self.handle.registerTimer(int(self._ends_ms(spans).min()))

    def _ends_ms(self, spans: np.ndarray) -> np.ndarray:
        return -(-(spans["last"] + self.gap_us) // 1000)

    def _events(self, rows: pd.DataFrame) -> np.ndarray:
        spans = np.empty(len(rows), SPAN)
        spans["null"], spans["key"], spans["n"] = rows["unkeyed"], rows["key"], 1
        spans["start"], spans["last"], spans["total"] = rows["us"], rows["us"], rows["amount"].fillna(0.0)
        return spans

    def _joined(self, spans: np.ndarray) -> np.ndarray:
        """``spans`` with those of one key that lie less than the gap apart made one."""
        spans = spans[np.lexsort((spans["start"], spans["key"], spans["null"]))]
        first = np.ones(len(spans), bool)
        first[1:] = (spans["key"][1:] != spans["key"][:-1]) | (spans["null"][1:] != spans["null"][:-1])
        reach = pd.Series(spans["last"]).groupby(first.cumsum()).cummax().to_numpy()
        first[1:] |= spans["start"][1:] >= reach[:-1] + self.gap_us
        at = np.flatnonzero(first)
        out = spans[at]
        out["last"] = np.maximum.reduceat(spans["last"], at)
        out["n"], out["total"] = np.add.reduceat(spans["n"], at), np.add.reduceat(spans["total"], at)
        return out

    def _out(self, spans: np.ndarray) -> pd.DataFrame:
        no_time = spans["start"] == NO_TIME
        return pd.DataFrame({"key": pd.arrays.IntegerArray(spans["key"].copy(), spans["null"] == 1),
                             "start_us": pd.arrays.IntegerArray(spans["start"].copy(), no_time),
                             "end_us": pd.arrays.IntegerArray(spans["last"] + self.gap_us, no_time),
                             "n_events": spans["n"], "total": spans["total"]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = np.concatenate([self._events(p) for p in rows])
        timed = events["start"] != NO_TIME
        if timed.any():
            self._hold(self._joined(np.concatenate([self._held(), events[timed]])))
        if not timed.all():
            yield self._out(events[~timed])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        done = self._ends_ms(held) <= timerValues.getCurrentWatermarkInMs()
        if done.any():   # a session that has grown since has a later timer
            self._hold(held[~done])
            yield self._out(held[done])

    def close(self) -> None:
        pass


def session_totals(df: DataFrame, key: str, ts: str, value: str, gap: str = "30 minutes",
                   delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """``(key, window_start, window_end, n_events, total)`` of each session of a stream, once,
    when the watermark passes its end (append mode; RocksDB state, see ``ROCKSDB``).

    State is the open sessions alone.  A call of the processor costs milliseconds whatever it
    does, so keys share ``buckets`` values of state (by hash; keep the number with the
    checkpoint), each handled at once per micro-batch: calls do not grow with the keys, and a
    value holds the open sessions of its share of a micro-batch.  A null key is a key; an event
    without a time is a session of its own, without a window, and leaves at once.  A stream that
    has ended keeps sessions open; a later event of any key, such as a heartbeat, moves the
    watermark and closes them.
    """
    ev = with_event_time(df, ts, delay)
    k = F.col(key).cast("long")
    # rows arrive as named tuples, whose fields cannot begin with an underscore
    rows = ev.select(F.pmod(F.xxhash64(k), F.lit(buckets)).alias("bucket"), k.isNull().cast("long").alias("unkeyed"),
                     F.coalesce(k, F.lit(0)).alias("key"), F.col("event_time"),
                     F.coalesce(F.unix_micros("event_time"), F.lit(NO_TIME)).alias("us"),
                     F.col(value).cast("double").alias("amount"))
    out = rows.groupBy("bucket").transformWithStateInPandas(
        _Sessions(interval_micros(gap)), SESSIONS, "append", "eventTime")
    return out.select("key", to_wall_time(F.timestamp_micros("start_us")).alias("window_start"),
                      to_wall_time(F.timestamp_micros("end_us")).alias("window_end"), "n_events", "total")
