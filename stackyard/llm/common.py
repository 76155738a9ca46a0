"""Shared small helpers of the operators in this package.

Input rule of every operator: it selects only the columns it was told to use
and renames them, so further columns, whatever their names, never clash.
"""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackyard.session import scratch_path


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id bigint, text string)`` of a table; a null text is the empty text."""
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back.

    Cuts the lineage: what follows reads files, so a lost executor repeats
    only reads, and generated ids keep their values.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A sort-merge join of tables that grow with the corpus.

    Of written tables Spark knows the bytes of the compressed files, which are a small part of what their rows
    take; a broadcast chosen by them passes through the driver's memory.
    """
    return left.join(right.hint("merge"), on, how)


def crc_mod(id_col: str, m: int) -> Column:
    """crc32 of the id as text, modulo ``m`` (null for a null id)."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(m))


def worker_state(name: str, make):
    """An object kept in a Python worker from task to task (a vocabulary, a cache).

    Task code is shipped by value, so module globals start anew in each task.
    """
    home = sys.modules.setdefault("_stackyard_worker_state",
                                  types.ModuleType("_stackyard_worker_state"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lean_memory() -> None:
    """In a Python worker: memory of freed arrays and Arrow batches goes back to the system at once.

    By default the allocators keep it, so that idle workers hold the peak of their last task.
    """
    def settle():
        import ctypes

        import pyarrow as pa
        mmap_threshold = -3   # of mallopt; larger blocks are mapped and unmapped one by one
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(mmap_threshold, 1 << 17)
        pa.set_memory_pool(pa.system_memory_pool())
        return True

    worker_state("lean_memory", settle)
