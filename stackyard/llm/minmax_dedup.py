"""Near-duplicate groups by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum
and its maximum, so 64 evaluations yield 128 values.  Minima and maxima
are banded apart (both agree with probability J, the Jaccard similarity), four
to a band: 32 bands.  A pair of similarity J shares no band with probability
(1 - J^4)^32, that is 5e-6 at J = 0.75 and less above.

1. One pass over the texts: shingle sets, their digests and band keys.  Rows
   with equal sets form one class; only classes go on.
2. In every bucket each member is paired with the bucket's smallest member,
   pairs that cannot reach the threshold by size are left out, and the rest
   are confirmed on full shingle sets.  Links are contracted to components.
3. Members of a bucket that are then still in different components are
   compared with each other, across components only.  Pairs known to be
   connected are never compared, which is what keeps a bucket of thousands of
   near copies linear.  A bucket of up to ``CROWD`` such members is compared in
   one group, so that each text travels once per bucket and not per pair;
   buckets of the same members count once.  The members of larger ones are put
   into buckets of their rarest shingles instead (prefix filter, which is
   exact): documents that share a passage but nothing else no longer meet.
   What is large even then is dealt into parts, and parts are compared two by
   two, so that a text travels once per pair of parts.

No unbounded bucket is collected and none is cut.  Hot buckets are aggregated
in the map tasks; joins on them are plain sort-merge joins that AQE splits.
No table is broadcast, so what reaches the driver does not grow with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackyard.llm.common import merged, saved, texts, worker_state
from stackyard.llm.components import components
from stackyard.llm.words import WordHasher, mix, slabs

SHINGLE_WORDS = 5
SIMILARITY = 75       # percent
ROWS_PER_BAND = 4
BANDS = 32            # half from minima, half from maxima
CROWD = 64            # members of a bucket beyond which rare shingles divide it
PART = 512            # rows of a large bucket that are compared with as many others in one group
COLUMNS = 1 << 13     # of a comparison matrix held at a time


def _permutations(n: int, seed: int):
    import numpy as np
    rng = np.random.default_rng(seed)
    draw = rng.integers(0, 1 << 63, (2, n), dtype=np.int64).astype(np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1] * np.uint64(2)


def band_keys(sets: list, rows: int, bands: int, seed: int):
    """``int64[len(sets), bands]`` band keys of non-empty shingle sets."""
    import numpy as np
    per_side = bands // 2
    a, b = _permutations(per_side * rows, seed)
    values = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), bands), np.uint64)
    for band in range(per_side):
        low = np.full(len(sets), band, np.uint64)
        high = np.full(len(sets), band + per_side, np.uint64)
        for j in range(band * rows, (band + 1) * rows):
            permuted = values * a[j] + b[j]
            low = mix(low) + np.minimum.reduceat(permuted, starts)
            high = mix(high) + np.maximum.reduceat(permuted, starts)
        out[:, band], out[:, band + per_side] = mix(low), mix(high)
    return out.view(np.int64)


def _signer(width: int, rows: int, bands: int, seed: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash
        hasher = worker_state("word_hasher", WordHasher)
        for batch in batches:
            text = batch.column("text").to_pylist()
            kept = [n for n in batch.schema.names if n != "text"]
            for lo, hi in slabs([len(t) for t in text]):
                sets = hasher.shingle_sets(text[lo:hi], width)
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(full, rows, bands, seed) if full else [])
                none = np.zeros(0, np.int64)
                yield pa.record_batch([*(batch.column(n).slice(lo, hi - lo) for n in kept),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([next(keys) if len(s) else none for s in sets], pa.list_(pa.int64())),
                ], names=[*kept, "n", "digest", "bands"])
    return run


def _signed(rows: DataFrame, width: int, bands: int, seed: int) -> DataFrame:
    """The columns of ``rows`` but ``text``, and ``n, digest, bands`` of its shingle set."""
    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_signer(width, ROWS_PER_BAND, bands, seed),
                           kept + "n bigint, digest binary, bands array<bigint>")


def _comparer(width: int, percent: int):
    def run(batches):
        import pyarrow as pa
        hasher = worker_state("word_hasher", WordHasher)
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb = batch.column("ta"), batch.column("tb")
            keep = []
            for lo, hi in slabs([1 << 10] * len(a)):
                text = {}
                for ids, column in ((a, ta), (b, tb)):
                    for i in range(lo, hi):
                        if ids[i] not in text:
                            text[ids[i]] = column[i].as_py()
                sets, nodes, held = {}, list(text), list(text.values())
                for x, y in slabs([len(t) for t in held]):
                    sets.update(zip(nodes[x:y], hasher.shingle_sets(held[x:y], width)))
                for i in range(lo, hi):
                    if _similar(sets[a[i]], sets[b[i]], percent):
                        keep.append(i)
            yield pa.record_batch([pa.array([a[i] for i in keep], pa.int64()),
                                   pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])
    return run


def _similar(p, q, percent: int) -> bool:
    import numpy as np
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= percent * (len(p) + len(q) - both)


def _shared_counts(left: list, right: list):
    """``float32[len(left), len(right)]``: how many shingles two sets share.

    Sets become rows of a 0/1 matrix over the shingles that occur on both sides, a
    slice of columns at a time, and a matrix product counts the matches.  If
    ``right`` is ``left``, a set is not counted against itself.
    """
    import numpy as np
    out = np.zeros((len(left), len(right)), np.float32)
    if right is left:
        common, often = np.unique(np.concatenate(left), return_counts=True)
        common = common[often > 1]
    else:
        common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    placed = []
    for sets in (left, right):
        values = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        column = np.minimum(np.searchsorted(common, values), max(len(common) - 1, 0))
        both = common[column] == values if len(common) else np.zeros(len(values), bool)
        order = np.argsort(column[both], kind="stable")
        placed.append((row[both][order], column[both][order]))
    for start in range(0, len(common), COLUMNS):
        parts = []
        for sets, (row, column) in zip((left, right), placed):
            a, b = np.searchsorted(column, [start, start + COLUMNS])
            dense = np.zeros((len(sets), min(COLUMNS, len(common) - start)), np.float32)
            dense[row[a:b], column[a:b] - start] = 1
            parts.append(dense)
        out += parts[0] @ parts[1].T
    return out


def _group_comparer(width: int, percent: int):
    """Links between the components that meet in a group of rows ``(node, root, part, text)``.

    Rows of two parts are compared across parts only; of one part, all.  Of the
    links, only those that join two components are given, fewer than rows.
    """
    def run(table):
        import numpy as np
        import pyarrow as pa
        hasher = worker_state("word_hasher", WordHasher)
        node, root, part = (np.array(table.column(c).to_pylist(), np.int64) for c in ("node", "root", "part"))
        held = table.column("text").to_pylist()
        sets = []
        for x, y in slabs([len(t) for t in held]):
            sets += hasher.shingle_sets(held[x:y], width)
        ours = np.flatnonzero(part == part.min())
        theirs = np.flatnonzero(part != part.min())
        left = [sets[i] for i in ours]
        right = [sets[i] for i in theirs] if len(theirs) else left
        theirs = theirs if len(theirs) else ours
        size = np.array([len(s) for s in sets], np.float64)
        both = _shared_counts(left, right).astype(np.float64)
        alike = 100 * both >= percent * (size[ours][:, None] + size[theirs][None, :] - both)
        i, j = np.nonzero(alike & (root[ours][:, None] != root[theirs][None, :]))
        joined = {r: r for r in root.tolist()}

        def top(r):
            while joined[r] != r:
                joined[r] = r = joined[joined[r]]
            return r

        keep = []
        for k, (x, y) in enumerate(zip(root[ours][i].tolist(), root[theirs][j].tolist())):
            x, y = top(x), top(y)
            if x != y:
                joined[x] = y
                keep.append(k)
        return pa.table({"a": pa.array(node[ours][i[keep]], pa.int64()), "b": pa.array(node[theirs][j[keep]], pa.int64())})
    return run


def _links(pairs: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets are similar enough."""
    both = merged(merged(pairs, rows.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a"),
                  rows.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return saved(both.select("a", "b", "ta", "tb").mapInArrow(
        _comparer(width, percent), "a bigint, b bigint"), "links")


def _size_can_do(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _buckets(classes: DataFrame) -> DataFrame:
    """``(bucket, node, pivot)`` of buckets with two or more members.

    The pivot is the member that meets the most others over all its buckets:
    among copies of one document that differ from each other, the document
    they were made from, which each of them is most like.
    """
    members = classes.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last"),
                                           F.count(F.lit(1)).alias("members")).filter("first != last")
    members = saved(merged(members, shared.select("bucket", "members"), "bucket"), "bucket-members")
    met = members.groupBy("node").agg(F.sum("members").alias("met"))
    heads = merged(members.select("bucket", "node"), met, "node").groupBy("bucket").agg(
        F.max(F.struct("met", (-F.col("node")).alias("first"))).alias("head"))
    heads = saved(heads.select("bucket", (-F.col("head.first")).alias("pivot")), "pivots")
    return saved(merged(members.select("bucket", "node"), heads, "bucket"), "buckets")


def _with_root(members: DataFrame, roots: DataFrame) -> DataFrame:
    return merged(members, roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _unsettled(members: DataFrame) -> DataFrame:
    """Members ``(bucket, node, root, members)`` of buckets that hold more than one component."""
    mixed = members.groupBy("bucket").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("members"))
    return merged(members, mixed.filter("lo != hi").select("bucket", "members"), "bucket")


def _shingles_of(width: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        hasher = worker_state("word_hasher", WordHasher)
        for batch in batches:
            text = batch.column("text").to_pylist()
            for lo, hi in slabs([len(t) for t in text]):
                sets = hasher.shingle_sets(text[lo:hi], width)
                sizes = np.array([len(s) for s in sets], np.int64)
                of = pa.array(np.repeat(np.arange(lo, hi), sizes))
                yield pa.record_batch(
                    [batch.column("node").take(of), batch.column("root").take(of),
                     pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets).view(np.int64))],
                    names=["node", "root", "n", "shingle"])
    return run


def _rare_buckets(crowded: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """The crowded buckets' members ``(bucket, node, root)`` by their rare shingles.

    With the shingles of each set in one order, rarest first, two sets of n and
    m shingles that are similar enough share one among the first
    ``n - ceil(percent * n / 100) + 1`` and as many of m.  So nothing is lost,
    and what all of a crowd have in common makes no bucket.
    """
    nodes = crowded.select("node", "root").distinct()
    shingles = saved(merged(rows, nodes, "node").mapInArrow(
        _shingles_of(width), "node bigint, root bigint, n bigint, shingle bigint"), "crowd-shingles")
    shared = saved(shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"),
                   "shared-shingles")
    own = merged(shingles, shared, "shingle")
    rarest = Window.partitionBy("node").orderBy("often", "shingle")
    # shingles of one member alone come first and need no bucket
    place = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("node")) + F.row_number().over(rarest)
    first = F.expr(f"n - ceil({percent} * n / 100) + 1")
    return own.withColumn("place", place).filter(F.col("place") <= first).select(
        F.col("shingle").alias("bucket"), "node", "root")


def _group_links(open_: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Links inside buckets ``(bucket, node, root, members)``; equal member sets count once.

    A bucket of more than ``PART`` members is dealt into parts of about that
    many, and every two parts are compared in a group of their own.
    """
    same = open_.groupBy("bucket", "members").agg(
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    once = saved(same.groupBy("x", "y", "members").agg(F.min("bucket").alias("bucket")), "once")
    parts = f"CAST(ceil(members / {PART}) AS INT)"
    dealt = (merged(open_.select("bucket", "node", "root", "members"), once.select("bucket"), "bucket", "left_semi")
             .withColumn("part", F.expr(f"CAST(pmod(xxhash64(node), {parts}) AS INT)"))
             .withColumn("other", F.explode(F.expr(f"sequence(0, {parts} - 1)")))
             .select("bucket", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"),
                     "node", "root", "part"))
    return saved(merged(dealt, rows, "node").groupBy("bucket", "lo", "hi").applyInArrow(
        _group_comparer(width, percent), "a bigint, b bigint"), "links")


def _candidates(nodes: DataFrame, classes: DataFrame, source: DataFrame) -> DataFrame:
    """``(node, text)`` of classes that meet another one; the one join that moves all texts.

    A text is found again by the id and hash of the row that stands for its class.
    """
    keys = merged(nodes, classes.select("node", "key", "hash"), "node")
    found = merged(source, keys.select("key", "hash"), ["key", "hash"], "left_semi").dropDuplicates(["key", "hash"])
    return saved(merged(found, keys, ["key", "hash"]).select("node", "text"), "candidates")


def _class_roots(classes: DataFrame, source: DataFrame, width: int, percent: int) -> DataFrame:
    buckets = _buckets(classes)
    rows = _candidates(buckets.select("node").distinct(), classes, source)
    size = classes.select("node", "n")
    star = buckets.filter("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    star = (merged(merged(star, size.select(F.col("node").alias("a"), F.col("n").alias("na")), "a"),
                   size.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
            .filter(_size_can_do(F.col("na"), F.col("nb"), percent)).select("a", "b"))
    links = _links(star, rows, width, percent)
    roots = components(links)
    members = buckets.select("bucket", "node")
    unsettled = saved(_unsettled(_with_root(members, roots)), "unsettled")
    links = links.unionByName(_group_links(unsettled.filter(F.col("members") <= CROWD), rows, width, percent))
    crowded = unsettled.filter(F.col("members") > CROWD)
    if not crowded.isEmpty():
        rare = saved(_unsettled(_rare_buckets(crowded, rows, width, percent)), "rare-unsettled")
        links = links.unionByName(_group_links(rare, rows, width, percent))
    return components(links)


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with the key and hash by which a text is found again."""
    return rows.withColumn("key", F.coalesce("id", F.lit(-(1 << 63)))).withColumn("hash", F.xxhash64("text"))


def _groups(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """``(rid, id, n_shingles, component_id, kept)`` of rows ``(rid, id, text)``."""
    rows = _keyed(rows)
    signed = saved(_signed(rows, width, BANDS, seed=7), "signatures")
    heads = signed.filter("n > 0").groupBy("digest").agg(F.min("rid").alias("node"))
    classes = saved(merged(signed, heads.select(F.col("node").alias("rid")), "rid").select(
        F.col("rid").alias("node"), "key", "hash", "n", "digest", "bands"), "classes")
    roots = _class_roots(classes, rows.select("key", "hash", "text"), width, percent)
    by_digest = saved(merged(classes.select("digest", "node"), roots, "node", "left").select(
        "digest", F.coalesce("root", "node").alias("root")), "class-roots")
    # without words a row is a component of its own; its root is no class
    light = signed.select("rid", "id", "n", "digest")
    grouped = saved(merged(light.filter("n > 0"), by_digest, "digest").select("rid", "id", "n", "root")
                    .unionByName(light.filter("n = 0").select("rid", "id", "n", F.expr("-1 - rid").alias("root"))),
                    "grouped")
    firsts = saved(grouped.groupBy("root").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("head")), "group-heads")
    return merged(grouped, firsts, "root").select(
        "rid", "id", F.col("n").alias("n_shingles"), F.col("head.id").alias("component_id"),
        (F.col("rid") == F.col("head.rid")).alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = SHINGLE_WORDS, percent: int = SIMILARITY) -> DataFrame:
    """One row per input row: ``id_col, n_shingles, component_id, kept``.

    Rows are linked when ``100 * |intersection| >= percent * |union|`` of
    their shingle sets; ``component_id`` is the smallest id reachable.  Null
    and empty texts, and texts without words, have an empty set and stand
    alone.  A null id never names a component that has another id; of
    repeated rows with the smallest id exactly one is kept.  An empty table
    gives no rows.  The input is read twice, so it must give the same rows each
    time (files, or a table that was written).
    """
    rows = texts(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("rid"), "id", "text")
    return _groups(rows, width, percent).drop("rid").withColumnRenamed("id", id_col)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         width: int = SHINGLE_WORDS, percent: int = SIMILARITY) -> DataFrame:
    """One row of each component of ``near_duplicates``, with all columns of ``docs``."""
    stored = saved(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                               F.monotonically_increasing_id().alias("rid")), "near-input")
    rows = stored.select("rid", F.col(f"doc.`{id_col}`").cast("bigint").alias("id"),
                         F.coalesce(F.col(f"doc.`{text_col}`"), F.lit("")).alias("text"))
    kept = _groups(rows, width, percent).filter("kept").select("rid")
    return merged(stored, kept, "rid", "left_semi").select("doc.*")
