"""Joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackyard.functions.strings import literal_pattern


def lookup(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Equi lookup of attributes from a dimension-like table.

    No hint: Spark broadcasts ``right`` when its bytes are under
    ``autoBroadcastJoinThreshold``, at planning or at run time (AQE), and sorts
    and merges otherwise.
    """
    return left.join(right, on, how)


def member_join(df: DataFrame, list_col: str, other: DataFrame, other_key: str,
                sep: str = ",", member_col: str = "member") -> DataFrame:
    """Join each row to ``other`` on exact membership of ``other_key``
    in the separated list ``list_col``.

    Explode then equi join; never a regex theta join (which is a nested loop
    and also hits ``node1`` inside ``node10``).  Repeated members in one list
    count once.
    """
    exploded = df.withColumn(member_col, F.explode(F.array_distinct(
        F.split(F.col(list_col), literal_pattern(sep)))))
    return exploded.join(other, exploded[member_col] == other[other_key], "inner")


def missing_dependencies(items: DataFrame, edges: DataFrame, node: str = "node",
                         item: str = "item", requires: str = "requires") -> DataFrame:
    """For each item placed on a node, the required items that the same
    node lacks.

    ``items(node, item)`` joined to ``edges(item, requires)`` on the item
    (equi join), then anti-joined with ``items`` on ``(node, requires)``.
    No pairs within a node are formed.
    """
    need = items.select(node, item).distinct().join(edges.select(item, requires), item)
    have = items.select(F.col(node).alias("_n"), F.col(item).alias("_i")).distinct()
    return need.join(have, (need[node] == have["_n"]) & (need[requires] == have["_i"]),
                     "left_anti")


def placement_gaps(hosts: DataFrame, present: DataFrame, catalog: DataFrame,
                   host: str = "host", package: str = "package") -> DataFrame:
    """J1 re-aimed: per host, how many catalog packages it has and lacks.

    The reference walks hosts x packages in a nested loop and skips what is
    present.  The gaps need no product: count the distinct present packages
    per host and subtract from the catalog size, a scalar subquery.  Equi
    joins and aggregates only.
    """
    n_catalog = catalog.select(F.count_distinct(package)).scalar()
    have = (present.join(catalog.select(package).distinct(), package, "left_semi")
            .select(host, package).distinct()
            .groupBy(host).agg(F.count(F.lit(1)).alias("n_present")))
    out = hosts.select(host).distinct().join(have, host, "left")
    n_present = F.coalesce(F.col("n_present"), F.lit(0)).cast("long")
    return out.select(host, n_present.alias("n_present"),
                      (n_catalog - n_present).cast("long").alias("n_missing"))


def semi(df: DataFrame, other: DataFrame, on: Sequence[str] | Column) -> DataFrame:
    """Rows of ``df`` with a match in ``other`` (EXISTS)."""
    return df.join(other, on, "left_semi")


def anti(df: DataFrame, other: DataFrame, on: Sequence[str] | Column) -> DataFrame:
    """Rows of ``df`` with no match in ``other`` (NOT EXISTS; NULL keys
    never match, so such rows are kept)."""
    return df.join(other, on, "left_anti")
