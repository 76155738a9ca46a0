"""Row routing and predicates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def route(df: DataFrame, key: str, cases: Mapping[str, str], out: str = "route",
          quarantine: str | None = None) -> tuple[DataFrame, DataFrame]:
    """map ``key`` values to a target (a ``case`` statement).

    Returns ``(known, unknown)``: rows with a listed value carry ``out``;
    the rest go to the quarantine output instead of being dropped.  Both
    outputs are filters over the same scan; no shuffle.
    """
    expr = None
    for value, target in cases.items():
        cond = F.col(key) == F.lit(value)
        expr = F.when(cond, F.lit(target)) if expr is None else expr.when(cond, F.lit(target))
    tagged = df.withColumn(out, expr if expr is not None else F.lit(None).cast("string"))
    known = tagged.where(F.col(out).isNotNull())
    unknown = tagged.where(F.col(out).isNull())
    if quarantine is not None:
        unknown = unknown.withColumn(out, F.lit(quarantine))
    return known, unknown


def text_class(x: Column | str, short_below: int) -> Column:
    """classify a text as null / empty / short / long by length."""
    x = F.col(x) if isinstance(x, str) else x
    return (F.when(x.isNull(), F.lit("null"))
            .when(F.length(x) == 0, F.lit("empty"))
            .when(F.length(x) < short_below, F.lit("short"))
            .otherwise(F.lit("long")))


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """U4: the table after ``DELETE FROM t WHERE condition``.

    Rows where the condition is NULL are kept, as SQL DELETE keeps them:
    the complement is ``NOT coalesce(condition, false)``.
    """
    return df.where(~F.coalesce(condition, F.lit(False)))
