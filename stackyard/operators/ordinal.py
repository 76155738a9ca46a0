"""Per-key positions, ranks, sliding frames, running sums, lag/lead and top-n, safe
under a hot key (SURVEY O3, K2, S10-S13).

A plain ``row_number() OVER (PARTITION BY key ...)`` sends a whole group to
one task; if one key holds a third of the table, that task holds a third of
the data.  Here rows are first dealt out by ranges of ``(key, order)``
(``repartitionByRange``), and the number of the range, the slice, becomes a
column.  Built-in windows then run per ``(slice, key)``, and the result is
written once.  What a window at a slice edge misses, because the key goes on
in the slices beside it, comes from a few rows per slice:

* positions, sums and sizes: the totals of the key's other slices;
* ``lag``, ``lead`` and frames of so many rows: the rows next to the edges;
* rank and dense rank: whether the first value of a slice is the last one of
  the slice before.

Only keys that go on over an edge need this, at most about two per slice, so
these tables are bounded by the number of slices (times the rows a frame
reaches over) and broadcast.  No group is larger than a slice, no rows are
joined with rows, and the plan that is returned reads the written rows without
a shuffle.  As the table is written, every branch sees the same slices.

Rows that are equal in all order columns are parted too: by a hash of the whole
row, then by a row number, so that slices are even whatever the data.

``top_n`` relies on Spark's window group limit: ``row_number() <= n`` is
applied per map partition before the shuffle, so each task ships at most n
rows per key.

Order items are column names (ascending) or ``desc("col")``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackyard.session import written

def desc(name: str) -> tuple[str, str]:
    """Order item: ``name`` descending (nulls last), as in SQL."""
    return (name, "desc")


def _spec(order) -> list[tuple[str, bool]]:
    """Order items (``"col"`` or ``("col", "desc")``) -> ``[(col, is_desc)]``."""
    out = []
    for o in order:
        if isinstance(o, str):
            out.append((o, False))
        else:
            name, direction = o
            out.append((name, direction.lower() == "desc"))
    return out


def _sort_cols(spec):
    return [F.col(c).desc() if d else F.col(c).asc() for c, d in spec]


SLICE, TIE, ROW = "_rp", "_sy_tie", "_sy_row"


def _hashable(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    return F.to_json(c) if "map<" in field.dataType.simpleString() else c


def slices(df: DataFrame, spec, n: int) -> DataFrame:
    """``df`` dealt out by ranges of the sort columns, with the range as ``SLICE``.

    ``TIE`` (a hash of the row) and ``ROW`` order rows that are equal in the sort
    columns, so that ranges can part them.  The ranges differ between runs of
    the plan: write what is computed from them before using it twice.
    """
    tied = df.select("*", F.xxhash64(*[_hashable(f) for f in df.schema.fields]).alias(TIE),
                     F.monotonically_increasing_id().alias(ROW))
    return tied.repartitionByRange(n, *_sort_cols(spec), TIE, ROW).select("*", F.spark_partition_id().alias(SLICE))


def with_slice(df: DataFrame, spec, n: int) -> DataFrame:
    """``slices`` as a written table."""
    return written(slices(df, spec, n), "slices")


def slice_count(df: DataFrame, partitions: int | None) -> int:
    return partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_slice(keys: Sequence[str], order=(), backwards: bool = False) -> WindowSpec:
    """Rows of one key in one slice, in the order of the slices (or backwards)."""
    cols = [*_sort_cols(order), F.col(TIE).asc(), F.col(ROW).asc()]
    if backwards:
        cols = [*_sort_cols([(c, not d) for c, d in order]), F.col(TIE).desc(), F.col(ROW).desc()]
    return Window.partitionBy(SLICE, *keys).orderBy(*cols)


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def going_on(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of a table of edge rows, those of keys that stand in several slices."""
    span = Window.partitionBy(*keys)
    return rows.select("*", (F.min(SLICE).over(span) < F.max(SLICE).over(span)).alias("_several")).where("_several")


def mended(rows: DataFrame, fixes: DataFrame, on: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``fixes``, a table bounded by the slice count, null where there
    is no fix (and, named ``_on_``, those they are joined on)."""
    cond = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    renamed = fixes.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in fixes.columns])
    return rows.join(F.broadcast(renamed), cond, "left")


def _positions(df: DataFrame, keys: list[str], order, sums: Sequence[str] = (),
               partitions: int | None = None) -> DataFrame:
    """``df`` plus ``_pos`` (0-based position in key) and ``_run_<c>``
    (running sum of ``c`` up to and including the row, in the type of
    ``sum(c)``; NULL adds nothing, and only NULLs so far give NULL).

    Local numbers and sums per (slice, key), shifted by what the key's earlier
    slices hold.
    """
    keys, order = list(keys), _spec(order)
    w = in_slice(keys, order)
    local = written(slices(df, [*_spec(keys), *order], slice_count(df, partitions)).select(
        "*", F.row_number().over(w).alias("_local"), *[F.sum(c).over(upto(w)).alias(f"_lsum_{c}") for c in sums],
        F.lead(F.lit(1)).over(w).isNull().alias("_end")), "positions")
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = going_on(local.where("_end").select(SLICE, *keys, "_local", *[f"_lsum_{c}" for c in sums]), keys).select(
        SLICE, *keys, F.coalesce(F.sum("_local").over(before), F.lit(0)).alias("_off"),
        *[F.sum(f"_lsum_{c}").over(before).alias(f"_offs_{c}") for c in sums])
    return mended(local, offsets, [SLICE, *keys]).select(
        *df.columns, (F.col("_local") - 1 + F.coalesce(F.col("_off"), F.lit(0))).alias("_pos"),
        *[F.coalesce(F.col(f"_lsum_{c}") + F.col(f"_offs_{c}"), f"_lsum_{c}", f"_offs_{c}")
          .alias(f"_run_{c}") for c in sums])


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on ``on`` where NULL equals NULL; the columns appear once."""
    cond = functools.reduce(lambda a, b: a & b,
                            [left[c].eqNullSafe(F.col(f"_on_{c}")) for c in on])
    renamed = right.select(*[F.col(c).alias(f"_on_{c}" if c in on else c) for c in right.columns])
    return left.join(renamed, cond, how).drop(*[f"_on_{c}" for c in on])


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence,
            out: str = "ordinal", base: int = 0, partitions: int | None = None) -> DataFrame:
    """O3: ``base``-based position of each row within its key, by ``order``.

    ``order`` must make rows unique within a key (add the id as the last
    column) so that reruns after an executor loss give the same ids.
    """
    p = _positions(df, list(keys), order, partitions=partitions)
    return p.select(*df.columns, (F.col("_pos") + base).alias(out))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence,
                value: str, out: str = "running_sum",
                partitions: int | None = None) -> DataFrame:
    """S12 (rows frame): sum of ``value`` from the first row of the key up to
    and including this row (``ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT
    ROW``); NULL values add nothing."""
    p = _positions(df, list(keys), order, [value], partitions=partitions)
    return p.select(*df.columns, F.col(f"_run_{value}").alias(out))


def ranks(df: DataFrame, keys: Sequence[str], value: str, tiebreak: str,
          descending: bool = True, tiles: int | None = None,
          partitions: int | None = None) -> DataFrame:
    """``row_number`` and ``ntile(tiles)`` by ``(value, tiebreak)``, and
    ``rank`` / ``dense_rank`` by ``value`` (equal values share a rank), per
    key.

    All four are built-in windows per (slice, key).  In a key's later slices the
    rows and the distinct values of the earlier ones are added; where the first
    value of a slice is the last one before it, that value is not counted
    again and its rows take the rank it had there.
    """
    keys = list(keys)
    by_value = _spec([desc(value) if descending else value])
    order = [*by_value, *_spec([tiebreak])]
    w = in_slice(keys, order)
    wv = Window.partitionBy(SLICE, *keys).orderBy(*_sort_cols(by_value))
    local = written(slices(df, [*_spec(keys), *order], slice_count(df, partitions)).select(
        "*", F.row_number().over(w).alias("_pos"), F.rank().over(wv).alias("_rank"), F.dense_rank().over(wv).alias("_dense"),
        F.count(F.lit(1)).over(Window.partitionBy(SLICE, *keys)).alias("_n")), "ranks")
    # one row per (slice, key): its last row, with the value of its first one
    span, at = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(SLICE)
    before, so_far = at.rowsBetween(Window.unboundedPreceding, -1), at.rowsBetween(Window.unboundedPreceding, 0)
    firsts = local.where("_pos = 1").select(SLICE, *keys, F.col(value).alias("_first"))
    lasts = local.where("_pos = _n").select(SLICE, *keys, F.col(value).alias("_last"), "_n", "_rank", "_dense")
    ends = null_safe_join(going_on(lasts, keys), firsts, [SLICE, *keys])
    ends = ends.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))) \
        .withColumn("_goes_on", F.coalesce(F.lag("_last").over(at).eqNullSafe(F.col("_first"))
                                           & F.lag(SLICE).over(at).isNotNull(), F.lit(False)))
    # the rank of a slice's last value: known here, unless the slice has but the value that goes on
    own = F.when(~F.col("_goes_on") | (F.col("_dense") > 1), F.col("_off") + F.col("_rank"))
    ends = ends.withColumn("_last_rank", F.last(own, ignorenulls=True).over(so_far))
    fixes = ends.select(
        SLICE, *keys, "_off", F.when(F.col("_goes_on"), F.lag("_last_rank").over(at)).alias("_held_rank"),
        (F.coalesce(F.sum("_dense").over(before), F.lit(0))
         - F.sum(F.col("_goes_on").cast("int")).over(so_far)).alias("_dense_off"),
        F.sum("_n").over(span).alias("_size"))
    j = mended(local, fixes, [SLICE, *keys])
    off = F.coalesce("_off", F.lit(0))
    held = F.col("_held_rank").isNotNull() & (F.col("_dense") == 1)
    j = j.withColumn("_at", F.col("_pos") - 1 + off)
    cols = [(F.col("_at") + 1).alias("row_number"),
            F.when(held, F.col("_held_rank")).otherwise(F.col("_rank") + off).cast("long").alias("rank"),
            (F.col("_dense") + F.coalesce("_dense_off", F.lit(0))).cast("long").alias("dense_rank")]
    if tiles:
        size = F.coalesce("_size", "_n")
        q, r = F.floor(size / tiles), size % tiles
        big = r * (q + 1)
        tile = (F.when(F.col("_at") < big, F.floor(F.col("_at") / (q + 1)) + 1)
                .otherwise(r + F.floor((F.col("_at") - big) / F.greatest(q, F.lit(1))) + 1))
        cols.append(tile.cast("long").alias("ntile"))
    return j.select(*df.columns, *cols)


@dataclass(frozen=True)
class Over:
    """A window value that looks ``back`` rows back and ``ahead`` rows ahead, or at the key's ends."""

    make: Callable[[WindowSpec], Column]
    back: int = 0
    ahead: int = 0
    whole: bool = False


def lag(col: str, offset: int = 1) -> Over:
    return Over(lambda w: F.lag(col, offset).over(w), back=offset)


def lead(col: str, offset: int = 1) -> Over:
    return Over(lambda w: F.lead(col, offset).over(w), ahead=offset)


def rows_frame(fn: Callable[[str], Column], col: str, back: int, ahead: int = 0) -> Over:
    """``fn(col)`` over ``ROWS BETWEEN back PRECEDING AND ahead FOLLOWING``, e.g. ``rows_frame(F.min, "v", 6)``."""
    return Over(lambda w: fn(col).over(w.rowsBetween(-back, ahead)), back=back, ahead=ahead)


_WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)


def first(col: str) -> Over:
    return Over(lambda w: F.first(col).over(w.rowsBetween(*_WHOLE)), whole=True)


def last(col: str) -> Over:
    return Over(lambda w: F.last(col).over(w.rowsBetween(*_WHOLE)), whole=True)


def over(df: DataFrame, keys: Sequence[str], order: Sequence, values: Mapping[str, Over],
         partitions: int | None = None) -> DataFrame:
    """``df`` plus window values, all from one pass over the slices.

    Rows near the edge of a slice, as many as the widest value reaches, are put
    beside the edge rows of the key's other slices, where the same windows run
    again: around each edge these rows stand without a gap.  The first and last
    value of a key are those of its first and last edge row.
    """
    keys, order, values = list(keys), _spec(order), dict(values)
    near = {c: v for c, v in values.items() if not v.whole}
    far = {c: v for c, v in values.items() if v.whole}
    reach = max(1, max([v.back for v in near.values()], default=0) + max([v.ahead for v in near.values()], default=0))
    w = in_slice(keys, order)
    held = {c: f"_v{i}" for i, c in enumerate(values)}
    local = written(slices(df, [*_spec(keys), *order], slice_count(df, partitions)).select(
        "*", *[v.make(w).alias(held[c]) for c, v in values.items()], F.row_number().over(w).alias("_at"),
        F.count(F.lit(1)).over(Window.partitionBy(SLICE, *keys)).alias("_n")), "over")
    edges = going_on(local.where((F.col("_at") <= reach) | (F.col("_at") > F.col("_n") - reach)), keys)
    along = Window.partitionBy(*keys).orderBy(SLICE, "_at")
    right = edges.select(SLICE, *keys, "_at", *[v.make(along).alias(f"_f{held[c]}") for c, v in values.items()])
    j = mended(local, right.select(SLICE, *keys, "_at", F.lit(True).alias("_edge"), *[f"_f{held[c]}" for c in near]),
               [SLICE, *keys, "_at"])
    if far:
        j = mended(j.drop(*[f"_on_{c}" for c in (SLICE, *keys)]), right.where("_at = 1").select(
            SLICE, *keys, F.lit(True).alias("_goes_on"), *[f"_f{held[c]}" for c in far]), [SLICE, *keys])
    cols = []
    for c, v in values.items():
        beside = F.col("_goes_on") if v.whole else F.col("_edge") & (
            (F.col("_at") <= v.back) | (F.col("_at") > F.col("_n") - v.ahead))
        cols.append(F.when(beside, F.col(f"_f{held[c]}")).otherwise(F.col(held[c])).alias(c))
    return j.select(*df.columns, *cols)


def shifted(df: DataFrame, keys: Sequence[str], order: Sequence, cols: Sequence[str],
            offset: int | Sequence[int] = 1, prefix: str | Sequence[str] = "lag_",
            partitions: int | None = None) -> DataFrame:
    """``lag`` (offset > 0) or ``lead`` (offset < 0) of ``cols`` within
    the key, for one or several offsets from a single pass."""
    offsets = [offset] if isinstance(offset, int) else list(offset)
    prefixes = [prefix] if isinstance(prefix, str) else list(prefix)
    return over(df, keys, order, {f"{p}{c}": lag(c, o) if o > 0 else lead(c, -o)
                                  for o, p in zip(offsets, prefixes) for c in cols}, partitions)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence, n: int,
          rank_col: str | None = None) -> DataFrame:
    """Top ``n`` rows per key by ``order`` (K2, S13); ``order`` should end in a
    unique tie-breaker.  Spark limits each map partition to n rows per key
    before the shuffle (window group limit), so a hot key ships n rows per
    task."""
    w = Window.partitionBy(*keys).orderBy(*_sort_cols(_spec(order)))
    ranked = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    if rank_col:
        return ranked.withColumnRenamed("_rn", rank_col)
    return ranked.drop("_rn")
