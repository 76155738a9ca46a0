"""As-of join: for each left row, the latest right row with the
same key at or before the left row's time.

Spark has no as-of join.  The usual composition (union both sides, then
``last(ignorenulls)`` over a window per key) puts a whole key in one task.
Here the union is cut into the range slices of ``operators.ordinal`` on (key,
time, side), so a hot key spans many slices; the window runs per (slice, key)
and what it finds is written once.  A left row with no right row earlier in
its own slice takes the carry-in: the last right row of the key's earlier
slices.  Only keys that cross a slice boundary need one (about two per
slice), so the carry-in table is bounded by the slice count and broadcast.
No pairs are formed.  As in SQL, a null key or a null time matches nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackyard.operators.ordinal import SLICE, going_on, in_slice, mended, slice_count, slices, upto
from stackyard.session import written


def asof_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str,
              right_cols: Sequence[str], right_tiebreak: str | None = None,
              partitions: int | None = None, strict: bool = False) -> DataFrame:
    """Left rows with ``right_cols`` of the matching right row (NULL when
    there is none).  Among right rows with equal time the largest
    ``right_tiebreak`` wins.  ``strict`` looks before the left time, not at
    it.  The times may be of any ordered type."""
    rcols = list(right_cols)
    rstruct = F.struct(*[F.col(c).alias(c) for c in rcols])
    lstruct = F.struct(*[F.col(c) for c in left.columns])
    # a null key or time matches nothing: such right rows go, such left rows stay unmatched
    right = right.where(F.col(key).isNotNull() & F.col(right_ts).isNotNull())
    tb = F.col(right_tiebreak) if right_tiebreak else F.lit(None)

    def time(df, name):
        c = F.col(name)
        return c.cast("timestamp_ntz") if isinstance(df.schema[name].dataType, T.TimestampType) else c

    r = right.select(F.col(key).alias("_k"), time(right, right_ts).alias("_t"),
                     F.lit(0).alias("_side"), tb.alias("_tb"), rstruct.alias("_r"))
    # in the sort, rights of the same time come first, or last when they do not count
    lft = left.select(F.col(key).alias("_k"), time(left, left_ts).alias("_t"),
                      F.lit(-1 if strict else 1).alias("_side"), F.lit(None).cast(r.schema["_tb"].dataType).alias("_tb"),
                      F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), lstruct.alias("_l"))
    r = r.withColumn("_l", F.lit(None).cast(lft.schema["_l"].dataType))
    order = [("_t", False), ("_side", False), ("_tb", False)]
    w = in_slice(["_k"], order)
    u = slices(r.unionByName(lft), [("_k", False), *order], slice_count(left, partitions)).select(
        "_k", "_t", "_side", "_l", SLICE, F.last("_r", ignorenulls=True).over(upto(w)).alias("_in"),
        F.lead(F.lit(1)).over(w).isNull().alias("_end"))
    u = written(u.where((F.col("_side") != 0) | F.col("_end")), "asof")
    # per (slice, key): the last right row; carried into the key's later slices
    before = Window.partitionBy("_k").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = going_on(u.where("_end").select(SLICE, "_k", "_in"), ["_k"]).select(
        SLICE, "_k", F.last("_in", ignorenulls=True).over(before).alias("_carry"))
    out = mended(u.where(F.col("_side") != 0), carry, [SLICE, "_k"])
    best = F.when(F.col("_k").isNotNull() & F.col("_t").isNotNull(), F.coalesce(F.col("_in"), F.col("_carry")))
    return out.select(*[F.col("_l")[c].alias(c) for c in left.columns],
                      *[best[c].alias(c) for c in rcols])
