"""Sharding over fixed virtual slots, with a versioned slot map.

A record's slot is a hash of its id, one of some thousands, and never changes.
A map says which shard holds each slot.  Bytes are aggregated per slot, and
rebalancing edits the map: it moves or swaps slots between the fullest and the
emptiest shard as long as that narrows the gap.  An edited map is a new version,
appended to a table of rows ``(version, vslot, shard)`` from which the next run goes
on, so a reader of an old version still finds its records (``located``), and
two versions differ only in the slots that move.

Slot statistics and maps are bounded by the number of slots and are edited on
the driver; records only look their shard up.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackyard.llm.common import saved, texts
from stackyard.session import scratch_path

MAP = "version int, vslot bigint, shard int"
SLOTS = 4096
SHARDS = 24
ROW_BYTES = 8


def slot_of(id_col: Column, text: Column, slots: int) -> Column:
    """The slot of a record: a hash of its id; records without an id spread by their text."""
    return F.pmod(F.coalesce(F.xxhash64(F.when(id_col.isNotNull(), id_col)), F.xxhash64(text)), F.lit(slots))


def first_map(slots: int, shards: int) -> list[int]:
    """Version 1: slots dealt out in turn."""
    return [s % shards for s in range(slots)]


def rebalance(sizes: Sequence[int], shard_of: Sequence[int], shards: int) -> list[int]:
    """The map edited until no move or swap between fullest and emptiest shard narrows their gap.

    ``sizes`` are bytes per slot.  Ends because each edit lowers the sum of
    squared loads.  Slots of no bytes stay where they are.
    """
    size, shard = np.asarray(sizes, np.int64), np.array(shard_of, np.int64)
    load = np.bincount(shard, size, shards).astype(np.int64)
    while True:
        order = np.argsort(load, kind="stable")
        high = order[-1]
        ours = np.flatnonzero((shard == high) & (size > 0))
        for low in order[:-1]:
            gap = int(load[high] - load[low])
            if gap <= 1 or not len(ours):
                return shard.tolist()
            theirs = np.flatnonzero((shard == low) & (size > 0))
            theirs = theirs[np.argsort(size[theirs], kind="stable")]
            have = np.concatenate([[0], size[theirs]])  # 0: a move without a swap
            # the swap partner that brings the difference nearest to half the gap
            wanted = size[ours] - gap / 2
            at = np.clip(np.searchsorted(have, wanted), 1, len(have) - 1) if len(have) > 1 else np.zeros(len(ours), int)
            best = None
            for near in (at - 1, at):
                near = np.maximum(near, 0)
                moved = size[ours] - have[near]
                off = np.where((moved > 0) & (moved < gap), np.abs(2 * moved - gap), gap)
                k = int(off.argmin())
                if off[k] < gap and (best is None or off[k] < best[0]):
                    best = (int(off[k]), int(ours[k]), int(near[k]), int(moved[k]))
            if best is not None:
                _, mine, other, moved = best
                shard[mine] = low
                if other:
                    shard[theirs[other - 1]] = high
                load[high] -= moved
                load[low] += moved
                break
        else:
            return shard.tolist()


def slot_map(spark: SparkSession, versions: Sequence[Sequence[int]], first: int = 1) -> DataFrame:
    """Rows ``(version, vslot, shard)``; versions count from ``first``."""
    rows = [(v, s, int(shard)) for v, m in enumerate(versions, first) for s, shard in enumerate(m)]
    return spark.createDataFrame(rows, MAP)


def last_map(stored: DataFrame) -> tuple[int, list[int]]:
    """The last version of a stored map, and its shards by slot (as many rows as slots reach the driver)."""
    version = stored.agg(F.max("version")).first()[0]
    if version is None:
        raise ValueError("the stored map has no version")
    rows = sorted((r.vslot, r.shard) for r in stored.filter(F.col("version") == version).collect())
    if [s for s, _ in rows] != list(range(len(rows))):
        raise ValueError(f"version {version} of the stored map does not hold each slot once")
    return version, [shard for _, shard in rows]


def located(docs: DataFrame, stored: DataFrame, version: int, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """``(id_col, vslot, shard)``: where a version of a stored map holds each row."""
    current = stored.filter(F.col("version") == version).select("vslot", "shard")
    slots = current.count()
    if not slots:
        raise ValueError(f"the stored map has no version {version}")
    rows = texts(docs, id_col, text_col).select("id", slot_of(F.col("id"), F.col("text"), slots).alias("vslot"))
    return rows.join(F.broadcast(current), "vslot").select(F.col("id").alias(id_col), "vslot", "shard")


def slot_sizes(records: DataFrame, slots: int) -> list[int]:
    """Bytes per slot of rows ``(vslot, size)``."""
    out = [0] * slots
    for r in records.groupBy("vslot").agg(F.sum("size").alias("size")).collect():
        out[r.vslot] = r["size"]
    return out


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shards: int = SHARDS, slots: int = SLOTS, stored: DataFrame | None = None,
                    map_path: str | None = None) -> DataFrame:
    """One row per input row: ``id_col, size, text_crc32, law, shard, slot, grown_shard,
    vslot, map_version``.

    The law is ``bytes``: a record's size is the UTF-8 bytes of its text (none
    for a null) plus 8, and the shards' sizes are as equal as moving whole
    slots makes them.  ``vslot`` is the virtual slot, ``slot`` the record's place in its
    shard, from 0 without gaps, by virtual slot, id and checksum; repeated
    rows get a place each.  ``grown_shard`` is null.  An empty table gives no rows.

    ``stored`` is the map that earlier runs wrote to ``map_path`` (Parquet): its last
    version is rebalanced, and appended as the next one if a slot moves.  Without it
    the map starts at version 1, in a new table (of the scratch folder without a path).
    One run at a time may write a map.
    """
    spark = docs.sparkSession
    if stored is None:
        version, current, new = 1, first_map(slots, shards), [first_map(slots, shards)]
    else:
        if map_path is None:
            raise ValueError("a stored map needs the path that its next version goes to")
        version, current = last_map(stored)
        new = []
        if len(current) != slots or not 0 <= min(current) <= max(current) < shards:
            raise ValueError(f"the stored map is not one of {slots} slots and at most {shards} shards")
    raw = texts(docs, id_col, text_col).withColumn("vslot", slot_of(F.col("id"), F.col("text"), slots))
    records = saved(raw.select("id", "vslot", (F.octet_length("text").cast("bigint") + ROW_BYTES).alias("size"),
                               F.crc32(F.col("text").cast("binary")).alias("text_crc32")), "records")
    edited = rebalance(slot_sizes(records, slots), current, shards)
    if edited != current:
        new, version = [*new, edited], version + 1
    path = map_path or scratch_path(spark, "slot-map")
    if new:   # in one file, so that a version is there as a whole or not at all
        slot_map(spark, new, version - len(new) + 1).coalesce(1).write.parquet(
            path, mode="append" if stored is not None else "errorifexists")
    current = spark.read.schema(MAP).parquet(path).filter(F.col("version") == version)
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    counted = records.groupBy("vslot").agg(F.count(F.lit(1)).alias("n"))
    # one row per slot: bounded by their number
    places = current.join(counted, "vslot").withColumn(
        "first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("vslot").orderBy("id", "text_crc32", "size")
    return (records.withColumn("row", F.row_number().over(inside)).join(F.broadcast(places), "vslot")
            .select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("first") + F.col("row") - 1).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"),
                    "vslot", F.col("version").alias("map_version")))
