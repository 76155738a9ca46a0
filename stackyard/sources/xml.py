"""XML property sets: ``<configuration><property><name/>
<value/><description/></property>...</configuration>``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackyard.operators.updates import upsert

PROPERTY_SCHEMA = "name string, value string, description string"


def read_xml_properties(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``<property>``; a missing description is NULL."""
    return (spark.read.format("xml").option("rowTag", "property")
            .schema(PROPERTY_SCHEMA).load(path))


def write_xml_properties(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``(name, value[, description])`` rows as property XML."""
    cols = [c for c in ("name", "value", "description") if c in df.columns]
    (df.select(*cols).write.mode(mode).format("xml")
     .option("rootTag", "configuration").option("rowTag", "property").save(path))


def overlay(base: DataFrame, extra: DataFrame, replace: bool = False,
            order: str | None = None) -> DataFrame:
    """Add properties to a set.  ``replace=False`` appends (duplicates of a
    name stay, as when lines are added before the closing tag);
    ``replace=True`` is an upsert by name, extra winning; of several rows of
    one name in ``extra`` the last by ``order`` wins (without it: the largest
    value)."""
    base = base.select("name", "value", F.col("description") if "description" in base.columns
                       else F.lit(None).cast("string").alias("description"))
    place = F.col(order) if order else F.lit(1)
    extra = extra.select("name", "value", F.col("description") if "description" in extra.columns
                         else F.lit(None).cast("string").alias("description"), place.alias("_seq"))
    if not replace:
        return base.unionByName(extra.drop("_seq"))
    return upsert(base, extra, ["name"], ["_seq", "value", "description"])
