"""Message-topic values.

A topic frame has the columns of Spark's Kafka source: ``key``, ``value``
(binary), ``topic``, ``partition``, ``offset``, ``timestamp``.  The
connector itself is a deployment jar; decoding works on any frame with that
shape, batch or stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOPIC_COLUMNS = ("key", "value", "topic", "partition", "offset", "timestamp")

# timestamps travel with microseconds (the JSON default keeps milliseconds)
JSON_TIME_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
                     "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def encode_topic(df: DataFrame, key: str, topic: str, partitions: int = 1) -> DataFrame:
    """Rows as topic records: JSON value, key bytes, partition by key hash,
    offsets in key-hash order are not assigned here (the broker does)."""
    return df.select(
        F.col(key).cast("string").cast("binary").alias("key"),
        F.to_json(F.struct(*df.columns), JSON_TIME_OPTIONS).cast("binary").alias("value"),
        F.lit(topic).alias("topic"),
        F.pmod(F.hash(F.col(key)), F.lit(partitions)).alias("partition"))


def decode_topic(df: DataFrame, schema: T.StructType | str,
                 keep: tuple[str, ...] = ("topic", "partition")) -> tuple[DataFrame, DataFrame]:
    """Parse JSON values.  Returns ``(decoded, rejects)``: values that are
    not JSON objects of the schema's types go to ``rejects`` with their raw
    text instead of turning into rows of NULLs."""
    text = F.col("value").cast("string")
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    options = {**JSON_TIME_OPTIONS, "columnNameOfCorruptRecord": "_corrupt"}
    checked = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = df.select(*[c for c in keep if c in df.columns], text.alias("_raw"),
                       F.from_json(text, checked, options).alias("_v"))
    # an array would be read as its first object, so the text has to start as one
    parsed = parsed.withColumn("_ok", F.coalesce(
        F.col("_raw").rlike(r"^\s*\{") & F.col("_v").isNotNull() & F.col("_v._corrupt").isNull(),
        F.lit(False)))
    decoded = parsed.where("_ok").select(*[c for c in keep if c in df.columns],
                                         *[F.col(f"_v.`{f.name}`") for f in schema.fields])
    rejects = parsed.where(~F.col("_ok")).select(*[c for c in keep if c in df.columns],
                                                 F.col("_raw").alias("value"))
    return decoded, rejects
