"""Relational import and export and federation
(IO14).

``import_jdbc`` splits the key range into ``n`` parallel reads; filters and
column selections applied afterwards are pushed into the source query.
No database ships with this repository; these functions take the caller's
URL and driver.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def import_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None,
                lo: int | None = None, hi: int | None = None, n: int = 1,
                properties: Mapping[str, str] | None = None) -> DataFrame:
    """IO8: partitioned bulk import.  With ``key`` the range ``[lo, hi]`` is
    cut into ``n`` strides read in parallel (rows outside still come, in
    the edge strides)."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if key is not None:
        if lo is None or hi is None:
            raise ValueError("lo and hi are needed with a partition key")
        r = (r.option("partitionColumn", key).option("lowerBound", str(lo))
             .option("upperBound", str(hi)).option("numPartitions", str(n)))
    return r.load()


def import_since(src: DataFrame, col: str, last) -> tuple[DataFrame, DataFrame]:
    """IO9: rows with ``col`` above the stored high-water mark ``last``, and
    the new mark as a one-row frame (a global max: a partial aggregate).
    Without new rows the mark stays ``last``, so the next run imports nothing
    again.  On a jdbc or Parquet source the filter reaches the scan."""
    rows = src.where(F.col(col) > F.lit(last)) if last is not None else src
    kept = F.lit(last).cast(src.schema[col].dataType)
    mark = rows.agg(F.coalesce(F.max(col), kept).alias("high_water_mark"))
    return rows, mark


def export_jdbc(df: DataFrame, url: str, table: str, mode: str = "append",
                properties: Mapping[str, str] | None = None, batch_size: int = 10_000,
                partitions: int | None = None) -> None:
    """IO10: bulk export; one connection per partition, so ``partitions``
    caps the load on the target database."""
    if partitions:
        df = df.coalesce(partitions)
    w = (df.write.format("jdbc").mode(mode).option("url", url).option("dbtable", table)
         .option("batchsize", str(batch_size)))
    for k, v in (properties or {}).items():
        w = w.option(k, v)
    w.save()


def register_sources(spark: SparkSession, specs: Mapping[str, Mapping]) -> None:
    """IO14: expose several sources as temp views for one ``spark.sql``.

    ``specs = {"view": {"format": "parquet", "path": ...},
               "other": {"format": "jdbc", "options": {...}}, ...}``
    Each view keeps its source's pushdown.
    """
    for name, spec in specs.items():
        r = spark.read.format(spec["format"])
        if spec.get("schema"):
            r = r.schema(spec["schema"])
        for k, v in (spec.get("options") or {}).items():
            r = r.option(k, v)
        df = r.load(spec["path"]) if spec.get("path") else r.load()
        df.createOrReplaceTempView(name)
