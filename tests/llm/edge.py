"""A small table with the awkward cases: nulls, empty and long texts, repeats, clashing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("the quick brown fox jumps over the lazy dog while nine other foxes watch it from the "
        "hill and wonder whether they should jump as well or rather stay where they are today")
LONG = " ".join(f"word{i % 977} again{i % 13}" for i in range(2_500))

ROWS = [
    (1, BASE), (2, BASE), (3, BASE + " indeed"), (4, None), (5, ""), (6, " \t\n "), (7, "one two"),
    (8, "one two"), (9, LONG), (10, LONG), (11, LONG + " end"), (12, "ONE Two"),
    (None, BASE), (None, "nothing like it"), (None, None), (13, "repeated row"), (13, "repeated row"),
    (14, "Über straße 日本語 😀 naïve"), (15, "x" * 5000), (16, "a\u0000b c"),
]
SCHEMA = ("doc_id bigint, text string, id string, rid int, node int, score string, n int, slice int, "
          "sha string, `a.b` string, `__score` int, part string")


def table(spark: SparkSession, rows=None) -> DataFrame:
    """Rows ``(doc_id, text)`` with further columns whose names operators use inside."""
    filled = [(i, t, "x", 1, 2, "s", 3, 4, None, "dot", 5, None) for i, t in (ROWS if rows is None else rows)]
    return spark.createDataFrame(filled, SCHEMA)
