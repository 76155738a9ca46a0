"""Exact dedup by deterministic block naming, in DataFrame operations only.

A text (its UTF-8 bytes) is cut into blocks of a fixed size.  All distinct
blocks are sorted and named by integers; adjacent names of a document are
paired, and the distinct pairs are sorted and named in turn, until every
document holds a single name.  Two documents have the same
``(number of blocks, name)`` exactly when their texts are identical: names
are given to whole contents, never to digests.

A block crosses the network once, to be named.  Its occurrences look the name
up under a 128-bit key of the block; the name table is checked to hold one
block per key, and a clash starts again under other key seeds, so a key never
decides equality on its own.

Hot contents (a third of all rows equal) are combined in the map tasks before
every naming shuffle, and the look-ups are plain sort-merge joins that AQE
splits on a skewed key.  The recursion takes log2(blocks of the longest text)
rounds; each round halves the rows and leaves finished documents behind.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackyard.llm.common import saved, texts

BLOCK_BYTES = 1024


def _cut(rows: DataFrame, size: int, seed: int, *keep: str) -> DataFrame:
    """``keep`` and ``blocks``: an array of ``(block, k1, k2)`` in text order.

    The text is cut as binary, where a substring copies its own bytes only; on
    a string each cut would scan from the start.
    """
    binary = rows.select(*keep, F.col("text").cast("binary").alias("bytes"))
    last = f"greatest(CAST(ceil(octet_length(bytes) / {size}) AS INT), 1) - 1"
    cut = (f"transform(sequence(0, {last}), "
           f"i -> substring(bytes, CAST(i * {size} + 1 AS INT), {size}))")
    return binary.select(*keep, F.expr(
        f"transform({cut}, b -> struct(b AS block, xxhash64({2 * seed}, b) AS k1, "
        f"xxhash64({2 * seed + 1}, b) AS k2))").alias("blocks"))


def _named(distinct: DataFrame, content: list[str], keep: list[str], label: str) -> DataFrame:
    """Distinct contents, sorted, with an integer name each."""
    return saved(distinct.sortWithinPartitions(*content)
                 .select(*keep, F.monotonically_increasing_id().alias("name")), label)


def _block_names(rows: DataFrame, size: int, seed: int) -> DataFrame | None:
    """``(k1, k2, name)`` of all distinct blocks, or None if two of them share a key."""
    distinct = _cut(rows, size, seed).select(F.inline("blocks")).distinct()
    names = _named(distinct, ["block"], ["k1", "k2"], "block-names")
    clash = names.groupBy("k1", "k2").count().filter("count > 1")
    return names if clash.isEmpty() else None


def _paired(seq: DataFrame) -> DataFrame:
    """One level up: adjacent names of a document become one name.

    An odd last name is paired with -1, which names nothing.
    """
    pairs = seq.groupBy("rid", F.expr("pos div 2").alias("pos")).agg(
        F.max("n").alias("n"),
        F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("a"),
        F.coalesce(F.max(F.expr("if(pos % 2 = 1, name, null)")), F.lit(-1)).alias("b"))
    names = _named(pairs.select("a", "b").distinct(), ["a", "b"], ["a", "b"], "pair-names")
    return saved(pairs.join(names, ["a", "b"]).select("rid", "n", "pos", "name"), "block-level")


def identities(rows: DataFrame, block_bytes: int = BLOCK_BYTES, seeds: int = 8) -> DataFrame:
    """``(rid, id, sha, n_blocks, name)`` of rows ``(rid, id, sha, text)``, rid unique.

    Equal texts, and no others, share ``(n_blocks, name)``.  The empty text
    is one empty block.
    """
    for seed in range(seeds):
        names = _block_names(rows, block_bytes, seed)
        if names is not None:
            break
    else:
        raise RuntimeError("block keys clash under every seed tried")
    keyed = saved(_cut(rows, block_bytes, seed, "rid", "id", "sha").select(
        "rid", "id", "sha", F.expr("transform(blocks, b -> struct(b.k1, b.k2))").alias("keys")),
        "document-keys")
    seq = saved(keyed.select("rid", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "k"))
                .select("rid", "n", "pos", "k.*").join(names, ["k1", "k2"])
                .select("rid", "n", "pos", "name"), "block-level")
    longest = seq.agg(F.max("n")).first()[0] or 1
    done = seq.filter("n = 1")
    for level in range(math.ceil(math.log2(longest))):
        seq = _paired(seq.filter(f"n > {1 << level}"))
        done = done.unionByName(seq.filter(f"n <= {2 << level}"))
    return done.select("rid", F.col("n").alias("n_blocks"), "name").join(
        keyed.select("rid", "id", "sha"), "rid")


def _grouped(rows: DataFrame, block_bytes: int) -> DataFrame:
    ids = saved(identities(rows, block_bytes), "identities")
    # written, so that the join below is a plain one, which AQE splits on a large group
    groups = saved(ids.groupBy("n_blocks", "name").agg(
        F.max(F.struct("id", "rid")).alias("keeper"), F.count(F.lit(1)).alias("group_size")), "groups")
    return ids.join(groups, ["n_blocks", "name"]).select(
        "rid", "id", F.col("keeper.id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("keeper.rid")).alias("kept"), F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays.  Null and empty texts
    are equal to each other.  A null id loses against any id; among repeated
    rows of the same id exactly one is kept.  An empty table gives no rows.
    The input is read twice, so it must give the same rows each time (files,
    or a table that was written).
    """
    rows = texts(docs, id_col, text_col).select(
        F.monotonically_increasing_id().alias("rid"), "id", "text",
        F.sha2(F.col("text"), 256).alias("sha"))
    return _grouped(rows, block_bytes).drop("rid").withColumnRenamed("id", id_col)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns."""
    columns = docs.columns
    stored = saved(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"),
                               F.monotonically_increasing_id().alias("rid")), "dedup-input")
    rows = stored.select(
        "rid", F.col(f"doc.`{id_col}`").cast("bigint").alias("id"),
        F.coalesce(F.col(f"doc.`{text_col}`"), F.lit("")).alias("text"),
        F.lit("").alias("sha"))
    kept = _grouped(rows, block_bytes).filter("kept").select("rid")
    return stored.join(kept, "rid", "left_semi").select("doc.*")
