"""Catalog statements: create and drop databases, run a SQL
script statement by statement through ``spark.sql``.  DDL runs on the
driver; the statements' queries run on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def split_statements(script: str) -> list[str]:
    """Split on ``;`` outside quotes (with backslash escapes) and comments
    (``--`` and ``/* */``).  Not a SQL parser: each piece goes to Spark as it is."""
    out, buf, quote, i = [], [], None, 0
    while i < len(script):
        ch = script[i]
        if quote:
            buf.append(ch)
            if ch == "\\" and quote != "`" and i + 1 < len(script):
                i += 1
                buf.append(script[i])
            elif ch == quote:
                quote = None
        elif ch in ("'", '"', "`"):
            quote = ch
            buf.append(ch)
        elif ch == "-" and script.startswith("--", i):
            j = script.find("\n", i)
            i = len(script) if j < 0 else j
            continue
        elif ch == "/" and script.startswith("/*", i):
            j = script.find("*/", i + 2)
            i = len(script) if j < 0 else j + 2
            buf.append(" ")
            continue
        elif ch == ";":
            out.append("".join(buf).strip())
            buf = []
        else:
            buf.append(ch)
        i += 1
    out.append("".join(buf).strip())
    return [s for s in out if s]


def run_script(spark: SparkSession, script: str) -> DataFrame | None:
    """Run every statement in order; return the last statement's result."""
    result = None
    for stmt in split_statements(script):
        result = spark.sql(stmt)
    return result


def create_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    """``CREATE DATABASE IF NOT EXISTS`` (strings are UTF-8 already, so a
    charset clause has no Spark counterpart)."""
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`{loc}")


def drop_database(spark: SparkSession, name: str) -> None:
    """Drop with its tables; no error when absent (the reference fails
    on a first run for lack of ``IF EXISTS``)."""
    spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")
