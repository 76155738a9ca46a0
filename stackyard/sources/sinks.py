"""Table sinks.

Paths are folders on shared storage.  Nothing here collects data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackyard.sources.manifest import VersionedTable

MODES = ("append", "overwrite", "ignore", "errorifexists")


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", fmt: str = "parquet",
                partition_by: list[str] | None = None, **options) -> None:
    """IO4/IO5: append, overwrite, create-if-absent (``ignore``) or fail if
    present (``errorifexists``)."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    w = df.write.mode(mode).format(fmt).options(**options)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def replace_table(spark: SparkSession, df: DataFrame, path: str) -> VersionedTable:
    """Replace a whole dataset under its own path in one step (see ``manifest``).

    ``df`` may read the table it replaces.  Readers that have opened the old
    version keep it until ``vacuum``.
    """
    table = VersionedTable(spark, path)
    table.replace(df)
    return table


def backup_once(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Keep only the first backup: later calls leave it as it is."""
    df.write.mode("ignore").format(fmt).save(path)


def overwrite_days(df: DataFrame, path: str, day_col: str, fmt: str = "parquet") -> None:
    """IO13: idempotent daily rerun.  Only the days present in ``df`` are
    replaced (dynamic partition overwrite); other days stay.

    No shuffle before the write: each task writes at most one file per day
    it holds, so a day that holds a third of the rows is still written by
    many tasks in parallel (a ``repartition(day)`` would give it one task).
    """
    (df.write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic")
     .partitionBy(day_col).format(fmt).save(path))


def overwrite_days_table(df: DataFrame, table: str, day_col: str, path: str | None = None, fmt: str = "parquet") -> None:
    """IO13: the daily rerun by the name of a catalog table, which the first run creates (at ``path``, if given).

    Only the days in ``df`` are replaced.  The rows are rebalanced by day
    before the write: AQE splits a day that holds much of the rows over several tasks of the
    advisory size and puts small days together, so a day has about its bytes over
    that size in files, not one file per task.  Columns go by name.
    """
    spark = df.sparkSession
    rows = df.hint("rebalance", F.col(day_col))
    if not spark.catalog.tableExists(table):
        writer = rows.write.partitionBy(day_col).format(fmt)
        (writer.option("path", path) if path else writer).saveAsTable(table)
        return
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    spark.conf.set(key, "dynamic")
    try:
        rows.select(*spark.table(table).columns).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(key, before)
