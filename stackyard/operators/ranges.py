"""Totals over ranges of values, without pairs.

``range_totals``: for each left row, the count and the sum of the right rows
of its key between its own two bounds.  The bounds are put among the right rows
as probes, all are sliced once (see ``ordinal``), and one running count gives
both ends: the total of a range is the one at its upper bound less the one before its
lower bound.  Work is linear in both tables, however many rows lie in a range.

``range_frame``: ``RANGE width PRECEDING`` frames with minimum and maximum,
which differences cannot give.  The axis is cut into blocks of the frame's own
width, so a frame is always the end of one block and the beginning of the
next: a suffix value at its lower bound and a prefix value at its upper one.
Both are running windows, so a row costs the same whatever the frame holds.  A
block that goes on over slice edges is mended by one row per slice.

``range_join`` returns rows: intervals of any width are cut into dyadic cells (at
most two per level), a point is offered to one cell of each level in use, and
an equi join on key and cell finds each pair exactly once.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackyard.operators.ordinal import SLICE, going_on, in_slice, mended, slice_count, slices, upto
from stackyard.session import written
from stackyard.streaming.events import EPOCH_NTZ, interval_micros

_LOW, _ROW, _HIGH = -1, 0, 1   # order of a lower bound, the rows and an upper bound at one place


def range_totals(left: DataFrame, right: DataFrame, key: str, lo: str, hi: str, at: str, value: str | None = None,
                 count: str = "n", total: str = "total", partitions: int | None = None) -> DataFrame:
    """Left rows with the ``count`` (and the sum of ``value`` as ``total``) of the right rows of
    the same ``key`` whose ``at`` lies in ``[lo, hi]``.

    As in SQL a null key or bound matches nothing: count 0, and a null total, as
    wherever no value lies in the range.
    """
    v = F.col(value) if value else F.lit(None).cast("long")
    r = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(
        F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(_ROW).alias("_side"), v.alias("_v"))
    row = F.struct(*[F.col(c) for c in left.columns])
    ends = F.array(F.struct(F.col(lo).alias("_t"), F.lit(_LOW).alias("_side")),
                   F.struct(F.col(hi).alias("_t"), F.lit(_HIGH).alias("_side")))
    probes = (left.select(F.col(key).alias("_k"), row.alias("_l"), ends.alias("_e"), F.monotonically_increasing_id().alias("_id"))
              .select("_k", "_id", F.explode("_e").alias("_e"), "_l")
              .select("_k", "_e._t", "_e._side", "_id", F.when(F.col("_e._side") == _HIGH, F.col("_l")).alias("_l")))
    u = r.unionByName(probes, allowMissingColumns=True)
    order = [("_t", False), ("_side", False)]
    w = in_slice(["_k"], order)
    sums = {"_c": (F.col("_side") == _ROW).cast("long")}   # rows, values and their sum so far
    if value:
        sums |= {"_m": F.col("_v").isNotNull().cast("long"), "_s": F.col("_v")}
    u = slices(u, [("_k", False), *order], slice_count(left, partitions)).select(
        "_k", "_t", "_side", "_id", "_l", SLICE, *[F.sum(c).over(upto(w)).alias(s) for s, c in sums.items()],
        F.lead(F.lit(1)).over(w).isNull().alias("_end"))
    u = written(u.where((F.col("_side") != _ROW) | F.col("_end")), "range-totals")
    before = Window.partitionBy("_k").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    earlier = going_on(u.where("_end").select(SLICE, "_k", *sums), ["_k"]).select(
        SLICE, "_k", *[F.sum(s).over(before).alias(f"{s}0") for s in sums])
    u = mended(u.where(F.col("_side") != _ROW), earlier, [SLICE, "_k"]).select(
        "_id", "_side", "_l", *[F.coalesce(F.col(s) + F.col(f"{s}0"), s, f"{s}0").alias(s) for s in sums],
        (F.col("_k").isNotNull() & F.col("_t").isNotNull()).alias("_known"))
    high, low = (u.where(F.col("_side") == side) for side in (_HIGH, _LOW))
    low = low.select(*[F.col(c).alias(f"_low{c}") for c in ("_id", "_known", *sums)])
    known = F.col("_known") & F.col("_low_known")

    def between(s: str) -> Column:
        return F.col(s) - F.coalesce(f"_low{s}", F.lit(0))

    cols = [F.when(known, F.greatest(between("_c"), F.lit(0))).otherwise(0).cast("long").alias(count)]
    if value:
        cols.append(F.when(known & (between("_m") > 0), between("_s")).alias(total))
    return high.join(low, F.col("_id") == F.col("_low_id")).select(
        *[F.col("_l")[c].alias(c) for c in left.columns], *cols)


def _both(fn: str, a: Column, b: Column) -> Column:
    """``fn`` of two parts from the parts' values; null is the value of nothing."""
    return {"min": F.least(a, b), "max": F.greatest(a, b), "sum": F.coalesce(a + b, a, b),
            "count": F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}[fn]


def _all(fn: str, c: Column) -> Column:
    return {"min": F.min, "max": F.max, "sum": F.sum, "count": F.sum}[fn](c)


def range_frame(df: DataFrame, keys: Sequence[str], at: str, width: int | float | str,
                values: Mapping[str, tuple[str, str | None]], partitions: int | None = None) -> DataFrame:
    """``df`` plus ``out: (fn, col)`` over ``RANGE BETWEEN width PRECEDING AND CURRENT ROW``.

    ``fn`` is ``min``, ``max``, ``sum`` or ``count`` (``col`` None counts rows).  ``at`` is a
    number, or a date or time with a ``width`` like ``"30 days"``.  As in SQL, null keys
    are a group, rows with a null ``at`` frame each other, and null values do not count.
    """
    keys, values = list(keys), dict(values)
    kind = df.schema[at].dataType
    x, size = F.col(at), width
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        x, size = F.timestamp_diff("MICROSECOND", F.expr(EPOCH_NTZ), x.cast("timestamp_ntz")), interval_micros(width)
    held = {c: f"_v{i}" for i, c in enumerate(values)}
    inputs = [(F.col(col).isNotNull().cast("long") if col else F.lit(1).cast("long")) if fn == "count" else F.col(col)
              for fn, col in values.values()]
    side = lambda s, place, block: F.struct(
        F.lit(s).alias("_side"), place.alias("_x"), block.alias("_b"), F.when(F.lit(s == _HIGH), F.col("_l")).alias("_l"),
        *[F.when(F.lit(s == _ROW), F.col(v)).alias(v) for v in held.values()])
    base = df.select(*keys, x.alias("_x"), F.struct(*[F.col(c) for c in df.columns]).alias("_l"),
                     *[v.alias(h) for v, h in zip(inputs, held.values())])
    base = base.withColumn("_b", F.floor(F.col("_x") / F.lit(size))).withColumn("_id", F.monotonically_increasing_id())
    u = base.select(*keys, "_id", F.explode(F.array(
        side(_LOW, F.col("_x") - F.lit(size), F.col("_b") - 1), side(_ROW, F.col("_x"), F.col("_b")),
        side(_HIGH, F.col("_x"), F.col("_b")))).alias("_e")).select(*keys, "_id", "_e.*")
    u = u.where((F.col("_side") != _LOW) | F.col("_x").isNotNull())   # rows without a place have no lower bound
    group, order = [*keys, "_b"], [("_x", False), ("_side", False)]
    w, back = in_slice(group, order), in_slice(group, order, backwards=True)
    u = slices(u, [*[(k, False) for k in group], *order], slice_count(df, partitions))
    u = u.select(*group, "_side", "_id", "_l", SLICE, F.lead(F.lit(1)).over(w).isNull().alias("_end"),
                 *[_all(fn, F.col(h)).over(upto(o)).alias(f"{n}{h}") for (fn, _), h in zip(values.values(), held.values())
                   for n, o in (("_p", w), ("_s", back))])
    u = written(u.where((F.col("_side") != _ROW) | F.col("_end")), "range-frame")
    at_slice = Window.partitionBy(*group).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*group).orderBy(F.desc(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    ends = going_on(u.where("_end").select(SLICE, *group, *[f"_p{h}" for h in held.values()]), group).select(
        SLICE, *group, *[_all(fn, F.col(f"_p{h}")).over(o).alias(f"{n}{h}") for (fn, _), h in
                         zip(values.values(), held.values()) for n, o in (("_before", at_slice), ("_after", after))])
    u = mended(u.where(F.col("_side") != _ROW), ends, [SLICE, *group])
    pick = lambda s, n, o, out: u.where(F.col("_side") == s).select(
        F.col("_id").alias(f"_id{s + 1}"), *(["_l"] if s == _HIGH else []),
        *[_both(fn, F.col(f"{n}{h}"), F.col(f"{o}{h}")).alias(f"{out}{h}") for (fn, _), h in zip(values.values(), held.values())])
    high, low = pick(_HIGH, "_p", "_before", "_hi"), pick(_LOW, "_s", "_after", "_lo")
    j = high.join(low, F.col(f"_id{_HIGH + 1}") == F.col(f"_id{_LOW + 1}"), "left")
    return j.select(*[F.col("_l")[c].alias(c) for c in df.columns],
                    *[_both(fn, F.col(f"_lo{h}"), F.col(f"_hi{h}")).alias(c)
                      for (c, (fn, _)), h in zip(values.items(), held.values())])


def _cells(a: Column, b: Column) -> Column:
    """The dyadic cells ``(level, cell)`` that make up the integers from ``a`` to ``b``."""
    end = b + 1

    def at_level(h: Column) -> Column:
        low, high = -F.call_function("shiftright", -a, h), F.call_function("shiftright", end, h)
        cell = lambda c: F.struct(h.alias("level"), c.alias("cell"))
        return F.array_compact(F.array(F.when((low < high) & (low % 2 != 0), cell(low)),
                                       F.when((low < high) & (high % 2 != 0), cell(high - 1))))

    top = F.ceil(F.log2((end - a).cast("double"))).cast("int")
    return F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(top, F.lit(0))), at_level))


def range_join(intervals: DataFrame, points: DataFrame, keys: Sequence[str], lo: str, hi: str, at: str,
               unit: float = 1.0) -> DataFrame:
    """Pairs of an interval and a point of the same ``keys`` with ``lo <= at <= hi``.

    ``unit`` is the width of the finest cell, about the narrowest interval that
    matters: finer cells are more rows, wider ones let through points that the
    exact condition then drops.  Null keys, bounds and places match nothing.
    """
    whole = lambda c: F.floor(F.col(c) / F.lit(unit)).cast("long")
    cut = intervals.where(F.col(lo) <= F.col(hi)).withColumn("_c", F.explode(_cells(whole(lo), whole(hi))))
    cut = cut.select(*intervals.columns, F.col("_c.level").alias("_level"), F.col("_c.cell").alias("_cell"))
    # only levels in use are offered: at most 64 numbers
    levels = sorted(r[0] for r in cut.select("_level").distinct().collect())
    offered = points.where(F.col(at).isNotNull()).withColumn("_p", whole(at)).withColumn(
        "_h", F.explode(F.array(*[F.lit(h) for h in levels]).cast("array<int>")))
    offered = offered.select(*[F.col(c).alias(f"_p_{c}") if c in keys else F.col(c) for c in points.columns],
                             F.col("_h").alias("_p_level"), F.call_function("shiftright", F.col("_p"), F.col("_h")).alias("_p_cell"))
    same = [F.col(k) == F.col(f"_p_{k}") for k in keys]
    cond = functools.reduce(lambda a, b: a & b, [
        *same, F.col("_level") == F.col("_p_level"), F.col("_cell") == F.col("_p_cell"),
        F.col(at) >= F.col(lo), F.col(at) <= F.col(hi)])
    return cut.join(offered, cond).drop("_level", "_cell", "_p_level", "_p_cell", *[f"_p_{k}" for k in keys])
