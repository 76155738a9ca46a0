"""Keyed updates on tables that have no MERGE.

Plain Parquet tables refuse ``MERGE INTO`` and ``DELETE FROM``, so updates
produce the new table as a DataFrame; writing it goes through
``sources.sinks.replace_table`` (write aside, then swap), never over a path
the same plan is reading.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackyard.operators.aggregates import last_per_key


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str],
           order: Sequence[str | Column]) -> DataFrame:
    """Delete by key, then insert the newest change per key.

    ``changes`` may hold several versions of one key; the largest ``order``
    wins (``max_by``, combined map-side).  A null key is a key like any other.  Keys match by equality, never by
    pattern, so upserting ``10.0.0.4`` leaves ``10.0.0.41`` alone.  The
    result has unique keys if ``base`` had, and running it twice with the
    same changes gives the same table (idempotent).
    """
    cols = base.columns
    latest = last_per_key(changes, keys, order, [c for c in cols if c not in keys]).select(*cols)
    gone = latest.select(*[F.col(k).alias(f"_gone_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_gone_{k}")) for k in keys]
    kept = base.join(gone, functools.reduce(lambda a, b: a & b, same), "left_anti")
    return kept.unionByName(latest)
