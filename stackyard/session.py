"""Session construction for tests and the bench, and shared-folder helpers.

Library code never builds a session; it takes the caller's.  Scratch output
(round trips, stream checkpoints, lineage cuts) goes under the folder the
cluster names in ``spark.checkpoint.dir``.  Only when that is unset on a local master (tests)
do we create one; elsewhere an unset folder is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def make_session(cpus: int | str = 8, shuffle_partitions: int | None = None,
                 app: str = "stackyard", extra: dict | None = None) -> SparkSession:
    """Local session with the settings our queries are designed for.

    On a cluster the same settings go in spark-defaults; the sizes that
    matter at scale are ``shuffle.partitions`` (aim for 128-256 MB per
    shuffle partition) and ``files.maxPartitionBytes`` (scan split size).
    """
    parts = shuffle_partitions or (int(cpus) if str(cpus).isdigit() else 8)
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(parts))
         .config("spark.default.parallelism", str(parts))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "8g")
         .config("spark.sql.streaming.schemaInference", "false"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; set a private one only when unset."""
    d = None
    try:
        d = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # conf not visible in this session kind
        d = None
    if not d:
        try:
            d = spark.sparkContext.getCheckpointDir()
        except Exception:
            d = None
    if not d:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="stackyard-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.sparkContext.setCheckpointDir(d)
        d = spark.sparkContext.getCheckpointDir() or d
    return d.rstrip("/")


def _scratch_root(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/stackyard/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never-reused folder of this application under the checkpoint root."""
    return f"{_scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back.

    Cuts the lineage: every branch of a later plan reads the same files, and a
    lost executor repeats only reads.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this application left in the scratch folder.  Frames that
    read it are of no use afterwards, so call it last."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
