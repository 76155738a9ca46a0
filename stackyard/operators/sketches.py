"""Stored sketches for distinct counts and quantiles of any range of days.

A HyperLogLog sketch and a KLL sketch per day and key are a few kilobytes, made
by one partial aggregate over the rows and kept as a table.  Sketches of days
merge without loss of what they know, so a range of days is answered from the
table, with no rescan of the rows, and a new day adds its own sketches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_sketches(df: DataFrame, day: str, keys: Sequence[str], id_col: str, value: str,
                   lg_size: int = 12) -> DataFrame:
    """``(day, keys, n, ids, dist)``: per day and key the rows, a distinct sketch of ``id_col``
    (about 1.6 % error at ``lg_size`` 12) and a quantile sketch of ``value``.  Null ids and
    values are not counted; rows with a null day have a sketch of their own, which no range takes."""
    return df.groupBy(day, *keys).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(F.col(id_col), lg_size).alias("ids"),
        F.kll_sketch_agg_double(F.col(value).cast("double")).alias("dist"))


def sketch_ranges(sketches: DataFrame, ranges: DataFrame, day: str, keys: Sequence[str],
                  quantiles: Sequence[float] = (0.5,), lo: str = "lo", hi: str = "hi") -> DataFrame:
    """``(lo, hi, keys, n, n_distinct, quantiles)`` for each of ``ranges`` (both days included).

    A range becomes its days and finds their sketches by an equi join; ranges
    without a sketch give no row, a key without values NULL quantiles.
    """
    days = ranges.where(F.col(lo) <= F.col(hi)).select(lo, hi, F.explode(F.sequence(lo, hi)).alias("_day")).distinct()
    merged = sketches.join(days, F.col(day) == F.col("_day")).groupBy(lo, hi, *keys).agg(
        F.sum("n").alias("n"), F.hll_union_agg("ids").alias("_ids"), F.kll_merge_agg_double("dist").alias("_dist"))
    known = F.kll_sketch_get_n_double("_dist") > 0
    at = [F.when(known, F.kll_sketch_get_quantile_double("_dist", F.lit(float(q)))) for q in quantiles]
    return merged.select(lo, hi, *keys, "n", F.hll_sketch_estimate("_ids").alias("n_distinct"), F.array(*at).alias("quantiles"))
