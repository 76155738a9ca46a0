"""Stream ingestion and stream sinks.

Every query here has a checkpoint folder on shared storage, so a restart
(or a lost executor) resumes from the last committed micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stackyard.operators.aggregates import last_per_key
from stackyard.sources.manifest import VersionedTable


def ingest_logs(spark: SparkSession, src_dir: str, schema, out: str, checkpoint: str,
                fmt: str = "json", max_files_per_trigger: int | None = None,
                available_now: bool = True, options: dict | None = None) -> StreamingQuery:
    """IO11: continuous file ingest to a Parquet table.

    New files under ``src_dir`` are picked up per micro-batch (at most
    ``max_files_per_trigger``), parsed with the given schema (no inference)
    and appended; the file sink's log makes the output exactly-once.
    ``available_now`` processes what is there and stops (a scheduled run);
    otherwise the query keeps running.
    """
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    for k, v in (options or {}).items():
        r = r.option(k, v)
    w = (r.load(src_dir).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def upsert_batch(table: VersionedTable, keys: Sequence[str], order: Sequence[str] = (), buckets: int = 64,
                 writer: str = "stream") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that upserts each micro-batch into a
    versioned table (``sources.manifest``) as one commit.

    Only the buckets a batch touches are read and rewritten.  The newest version of a key (largest
    ``order``; the later batch when no order is given) wins against the table too.  A batch that is replayed after a failure is either
    applied already, which the table knows by ``writer`` and batch id, or has left
    nothing that can be seen.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, keys, order, buckets, writer, batch_id)
    return apply


def append_updates(table: VersionedTable, keys: Sequence[str], compact_every: int = 20,
                   writer: str = "stream") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for update-mode aggregates: each micro-batch's changed rows, with
    its batch id, are one appended commit (a replayed batch is known by its id).  Every
    ``compact_every`` batches the log is rewritten to the newest row of each key, so it
    grows with the keys, not with the batches.  Read with ``read_latest``."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        table.append(batch.withColumn("_batch_id", F.lit(batch_id).cast("long")), writer, batch_id)
        if batch_id % compact_every == compact_every - 1:
            table.compact(keys, ["_batch_id"])
            table.vacuum()
    return apply


def read_latest(table: VersionedTable, keys: Sequence[str]) -> DataFrame:
    """The newest version of every key in an ``append_updates`` log: a
    ``max_by`` on the batch id, combined map-side."""
    log = table.read()
    cols = [c for c in log.columns if c not in (*keys, "_batch_id")]
    return last_per_key(log, list(keys), ["_batch_id"], cols)


def start_available_now(spark: SparkSession, writer, checkpoint: str,
                        state_partitions: int | None = None, conf: dict | None = None):
    """Start ``writer`` with ``availableNow`` and wait for it.

    The number of state partitions of a stateful stream is fixed by
    ``spark.sql.shuffle.partitions`` when the query first starts (then kept
    in the checkpoint).  It is set for the start only, by default to the
    cluster's parallelism (total executor cores), and the session value is
    restored right after, as are further settings in ``conf``; the stream runs
    on a copy of the session conf.
    """
    n = state_partitions or spark.sparkContext.defaultParallelism
    settings = {"spark.sql.shuffle.partitions": str(n), **(conf or {})}
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return q
