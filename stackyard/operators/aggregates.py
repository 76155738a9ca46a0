"""Keyed aggregations.

All are declared as ``groupBy().agg()`` with built-in aggregate functions,
so Spark runs a partial aggregate before the shuffle: a hot key is combined
map-side and ships one buffer per map task, not its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackyard.operators.ordinal import _positions


def _cols(xs):
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def ordered_concat(df: DataFrame, keys: Sequence[str], value: str | Column,
                   order: Sequence[str | Column], sep: str = ",", lead: bool = False,
                   out: str = "joined") -> DataFrame:
    """A1/A2: ``listagg(value, sep) WITHIN GROUP (ORDER BY order)`` per key.

    ``lead=True`` keeps a separator before the first element too (the shell
    fold ``acc=$acc:$x``).  The order columns should be unique within a key;
    ties fall back to the value.  The result is one string per key, so this is
    for groups that fit in one value and so in one buffer; ``concat_parts`` has
    no such bound.
    """
    val = value if isinstance(value, Column) else F.col(value)
    item = F.struct(*_cols(order), val.cast("string").alias("_v"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda e: e["_v"]), sep)
    if lead:
        joined = F.concat(F.lit(sep), joined)
    return df.groupBy(*keys).agg(joined.alias(out))


def concat_parts(df: DataFrame, keys: Sequence[str], value: str, order: Sequence, sep: str = ",",
                 lead: bool = False, part_bytes: int = 1 << 20, out: str = "joined",
                 partitions: int | None = None) -> DataFrame:
    """A1/A2 for groups of any size: ``(keys, part, out)``, where the parts of a key, put one
    after the other, are what ``ordered_concat`` gives.

    The bytes before each value are a running sum that is safe under a hot key
    (``ordinal``), and a value belongs to the part in which it begins, so a buffer
    holds ``part_bytes`` and one value more.  Null values do not count; a key with
    nothing else has one empty part.  ``order`` (column names or ``desc``) must be
    unique within a key.
    """
    joined = F.concat(F.lit(sep), F.coalesce(F.col(value).cast("string"), F.lit("")))
    rows = df.select(*df.columns, F.when(F.col(value).isNull(), F.lit("")).otherwise(joined).alias("_v"))
    rows = rows.withColumn("_b", F.octet_length("_v").cast("long"))
    at = _positions(rows, list(keys), order, ["_b"], partitions=partitions)
    part = F.floor((F.col("_run__b") - F.col("_b")) / F.lit(part_bytes))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_v"))), lambda e: e["_v"]), "")
    parts = at.groupBy(*keys, part.cast("long").alias("part")).agg(text.alias(out))
    if lead:
        return parts
    first = F.substring(out, len(sep) + 1, 2_147_483_647)   # no separator before the first value
    return parts.withColumn(out, F.when(F.col("part") == 0, first).otherwise(F.col(out)))


def _by(df, keys, order, cols, fn):
    cols = list(cols) if cols else [c for c in df.columns if c not in keys]
    payload = F.struct(*[F.col(c) for c in cols])
    ordk = F.struct(*_cols(order))
    return df.groupBy(*keys).agg(fn(payload, ordk).alias("_p")).select(*keys, "_p.*")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                  cols: Sequence[str] | None = None) -> DataFrame:
    """A5: the row with the smallest ``order`` per key (``min_by``).

    ``order`` must be unique within a key (add a tie-breaker such as the id);
    then the result is deterministic and the aggregate combines map-side.
    """
    return _by(df, keys, order, cols, F.min_by)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                 cols: Sequence[str] | None = None) -> DataFrame:
    """The row with the largest ``order`` per key (``max_by``): last write wins."""
    return _by(df, keys, order, cols, F.max_by)


def status_report(expected: DataFrame, actual: DataFrame, keys: Sequence[str],
                  present: str = "present", missing: str = "missing") -> DataFrame:
    """Count expected rows by outcome, present (semi join) or missing
    (anti join) in ``actual``.  ``actual`` is reduced to distinct keys first
    (a partial aggregate), so duplicates there do not multiply rows."""
    seen = actual.select(*keys).distinct().withColumn("_hit", F.lit(True))
    tagged = expected.join(seen, list(keys), "left")
    status = F.when(F.col("_hit"), F.lit(present)).otherwise(F.lit(missing))
    return tagged.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def telemetry_rollup(df: DataFrame, keys: Sequence[str], ts: str, value: str,
                     width: str = "1 hour", percentiles: Sequence[float] = (0.5, 0.95),
                     accuracy: int = 10000) -> DataFrame:
    """count/min/max/avg and approximate percentiles per key and time bucket.

    Percentiles use ``percentile_approx`` (a mergeable sketch with bounded
    memory per group) rather than the exact ``percentile``, which buffers
    every value of a group in one task.
    """
    aggs = [F.count(F.lit(1)).alias("n"), F.min(value).alias("v_min"),
            F.max(value).alias("v_max"), F.avg(value).alias("v_avg"), F.sum(value).alias("v_sum")]
    for p in percentiles:
        aggs.append(F.percentile_approx(value, p, accuracy).alias(f"p{int(round(p * 100)):02d}"))
    return (df.groupBy(F.window(ts, width).start.alias("window_start"), *keys).agg(*aggs))
