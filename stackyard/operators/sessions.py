"""Batch sessionization that survives a hot key.

``session_window`` in a batch plan shuffles every event of a key to one
task and merges sessions there.  Here events are cut into the range slices of
``operators.ordinal`` (a hot key spans many slices), sessions are found
inside each (slice, key) with window functions and written once, and then stitched
across slice boundaries: the first session of a slice continues the last
session of the key's previous slice when the gap between them is below
``gap``.  Stitching needs one row per (slice, key) and only keys that cross
a slice boundary (about two per slice), a table bounded by the slice count
that is broadcast.  What is left is one aggregate.

Session bounds follow Spark's session windows: start at the first event,
end at the last event plus the gap; an event exactly ``gap`` after the
previous one starts a new session.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackyard.operators.ordinal import SLICE, going_on, in_slice, mended, slice_count, slices, upto
from stackyard.session import written


def sessionize(df: DataFrame, key: str, ts: str, gap: str, tiebreak: str,
               aggs: Sequence[Column] = (), partitions: int | None = None) -> DataFrame:
    """``(window_start, window_end, key, aggs...)`` per session of ``key``."""
    gap_iv = F.expr(f"INTERVAL {gap}")
    order = [(ts, False), (tiebreak, False)]
    w = in_slice([key], order)
    prev = F.lag(ts).over(w)
    local = slices(df, [(key, False), *order], slice_count(df, partitions)).withColumn(
        "_brk", F.when(prev.isNull() | (F.col(ts) >= prev + gap_iv), 1).otherwise(0))
    local = written(local.select("*", F.sum("_brk").over(upto(w)).alias("_ls"), F.first(ts).over(upto(w)).alias("_first"),
                                 F.lead(F.lit(1)).over(w).isNull().alias("_end")), "sessions")
    # one row per (slice, key), its last event: first and last time, local session count
    spans = going_on(local.where("_end").select(SLICE, key, "_first", F.col(ts).alias("_last"), F.col("_ls").alias("_s")),
                     [key])
    at = Window.partitionBy(key).orderBy(SLICE)
    cont = F.when(F.lag("_last").over(at).isNotNull() & (F.col("_first") < F.lag("_last").over(at) + gap_iv), 1).otherwise(0)
    shifts = spans.withColumn("_c", cont).select(
        SLICE, key, (F.coalesce(F.sum("_s").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                     - F.sum("_c").over(upto(at))).alias("_shift"))
    j = mended(local, shifts, [SLICE, key])
    sid = F.col("_ls") + F.coalesce(F.col("_shift"), F.lit(0))
    out = j.groupBy(key, sid.alias("_session")).agg(
        F.min(ts).alias("window_start"), (F.max(ts) + gap_iv).alias("window_end"), *aggs)
    return out.drop("_session")
