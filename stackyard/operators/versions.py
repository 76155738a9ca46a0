"""Versioned cells, as in a wide-column store.

A cell is ``(row_key, qualifier, version, value)``; several versions of one
cell may exist.  Reads are declared as aggregates or filters so they run as
partial aggregates or pushed-down scans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackyard.operators.aggregates import last_per_key
from stackyard.operators.ordinal import desc, top_n

CELL_KEYS = ("row_key", "qualifier")


def latest(cells: DataFrame, version: Sequence[str] = ("version",),
           keys: Sequence[str] = CELL_KEYS) -> DataFrame:
    """K1: newest version of every cell (``max_by``, combined map-side)."""
    return last_per_key(cells, list(keys), list(version))


def versions(cells: DataFrame, n: int, version: Sequence[str] = ("version",),
             keys: Sequence[str] = CELL_KEYS) -> DataFrame:
    """K2: at most the ``n`` newest versions of every cell."""
    return top_n(cells, list(keys), [desc(v) for v in version], n)


def write_sorted(cells: DataFrame, path: str, key: str = "row_key", mode: str = "errorifexists",
                 rows_per_file: int = 5_000_000) -> None:
    """Lay cells out range-partitioned and sorted by row key, so each file
    covers a narrow key range and its Parquet min/max statistics let a
    range scan skip the rest.

    Files follow the data: AQE puts small ranges together up to the advisory
    partition size, and a range of more than ``rows_per_file`` rows is cut into several files."""
    (cells.repartitionByRange(key).sortWithinPartitions(key)
     .write.mode(mode).option("maxRecordsPerFile", str(rows_per_file)).parquet(path))


def scan(cells: DataFrame, start: str | None = None, stop: str | None = None,
         prefix: str | None = None, key: str = "row_key") -> DataFrame:
    """K3: row keys in ``[start, stop)`` and/or starting with ``prefix``.
    Both are plain comparisons, pushed into the Parquet scan."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(key) >= F.lit(start))
    if stop is not None:
        cond = cond & (F.col(key) < F.lit(stop))
    if prefix is not None:
        cond = cond & F.col(key).startswith(prefix)
    return cells.where(cond)


def apply_deletes(cells: DataFrame, markers: DataFrame, version: str = "version",
                  key: str = "row_key") -> DataFrame:
    """K4: a delete marker ``(row_key, version)`` hides every cell of the row
    with ``version <= marker``.  Only the newest marker per row matters, so
    markers are reduced per row (an aggregate) and joined by row key; no
    cell is compared with every marker."""
    newest = markers.groupBy(key).agg(F.max(version).alias("_deleted_upto"))
    j = cells.join(newest, key, "left")
    return j.where(F.col("_deleted_upto").isNull() | (F.col(version) > F.col("_deleted_upto"))) \
        .drop("_deleted_upto")
