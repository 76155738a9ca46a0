"""Versioned Parquet tables with one-step commits.

A table is a folder of immutable data files and a folder of small manifests.
A manifest is one version: the list of data files, by bucket of the key where
the table has one.  A writer puts its files under a folder of its own, writes
the manifest aside and publishes it by a rename that fails if the version
exists; that one step is the commit.  Before it, nothing of the write can be
seen; after it, all of it.  There is no moment without a table, readers keep
the version they have opened, and of two writers that started from the same
version one is told so (``Conflict``) and starts again from the new one.

What a writer that died left behind is never listed by a manifest; ``vacuum``
removes it together with old versions.

A manifest names its writer and the last batch of each stream, so a micro-batch
that is replayed after a failure is seen to be applied already.  The table must lie on
a file system with atomic renames (HDFS, local, most shared file systems).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackyard.operators.aggregates import last_per_key
from stackyard.session import written

BUCKET, BATCH = "_bucket", "_batch_id"


class Conflict(RuntimeError):
    """Another writer published the version that this one was about to publish."""


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")


class VersionedTable:
    """A table at ``path``; ``None`` versions mean the newest."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    # files

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("x").getFileSystem(self._conf)

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(), self._at(folder)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _read_file(self, name: str) -> str:
        stream = self._fs().open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put_aside(self, text: str) -> str:
        name = f"_versions/.{uuid.uuid4().hex}.tmp"
        stream = self._fs().create(self._at(name), False)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        return name

    def _publish(self, aside: str, version: int) -> None:
        """The commit: a rename that fails if the version is there already."""
        fs = self._jvm.org.apache.hadoop.fs
        files = fs.FileContext.getFileContext(self._at("x").toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        options[0] = fs.Options.Rename.NONE
        try:
            files.rename(files.makeQualified(self._at(aside)), files.makeQualified(self._at(f"_versions/{version:012d}.json")),
                         options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                raise Conflict(f"version {version} of {self.path} exists") from None
            raise

    # versions

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("_versions") if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version; None for a table without any."""
        if version is None:
            known = self.versions()
            if not known:
                return None
            version = known[-1]
        return json.loads(self._read_file(f"_versions/{version:012d}.json"))

    def _files(self, commit: str) -> list[list]:
        """``[bucket or None, path below the table]`` of the files of one commit."""
        out, todo = [], [f"data/{commit}"]
        while todo:
            folder = todo.pop()
            for name in self._names(folder):
                if name.startswith(f"{BUCKET}="):
                    todo.append(f"{folder}/{name}")
                elif not name.startswith(("_", ".")):
                    bucket = folder.rpartition(f"{BUCKET}=")[2] if BUCKET in folder else None
                    out.append([None if bucket is None else int(bucket), f"{folder}/{name}"])
        return sorted(out, key=lambda x: x[1])

    def _stage(self, df: DataFrame, by_bucket: bool) -> tuple[str, list[list]]:
        """Write ``df`` under a new folder; nothing lists it yet."""
        commit = f"commit={uuid.uuid4().hex}"
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(BUCKET) if by_bucket else writer).parquet(f"{self.path}/data/{commit}")
        return commit, self._files(commit)

    def _commit(self, parent: dict | None, files: list, schema: T.StructType, keys, buckets, writer, batch) -> int:
        version = parent["version"] + 1 if parent else 1
        batches = dict(parent["batches"]) if parent else {}
        if writer is not None and batch is not None:
            batches[writer] = batch
        aside = self._put_aside(json.dumps({
            "version": version, "files": files, "schema": json.loads(schema.json()), "keys": list(keys),
            "buckets": buckets, "batches": batches}))
        self._publish(aside, version)
        return version

    def _frame(self, manifest: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        files = [f for b, f in manifest["files"] if buckets is None or b in buckets]
        if not files:
            empty = self.spark.createDataFrame([], schema)
            return empty.withColumn(BUCKET, F.lit(None).cast("int")) if manifest["buckets"] else empty
        if manifest["buckets"]:
            schema = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
        df = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(
            *[f"{self.path}/{f}" for f in files])
        if buckets is not None:
            df = df.where(F.col(BUCKET).isin(sorted(buckets)))
        return df.select(*[f.name for f in schema.fields])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of one version, which stay the same however often the table is written."""
        manifest = self.manifest(version)
        if manifest is None:
            raise FileNotFoundError(f"no table at {self.path}")
        rows = self._frame(manifest)
        return rows.drop(BUCKET, BATCH) if manifest["buckets"] else rows

    # writes

    def replace(self, df: DataFrame) -> int:
        """A new version that holds ``df`` alone, which may read the table itself."""
        parent = self.manifest()
        _, files = self._stage(df, by_bucket=False)
        return self._commit(parent, files, df.schema, [], 0, None, None)

    def append(self, df: DataFrame, writer: str | None = None, batch: int | None = None, tries: int = 5) -> int:
        """A new version with the rows of ``df`` added, of a table without buckets."""
        files = None
        for _ in range(tries):
            parent = self.manifest()
            if parent and batch is not None and parent["batches"].get(writer, -1) >= batch:
                return parent["version"]
            if parent and parent["buckets"]:
                raise ValueError(f"{self.path} is a keyed table")
            if files is None:
                _, files = self._stage(df, by_bucket=False)
            try:
                return self._commit(parent, (parent["files"] if parent else []) + files, df.schema, [], 0, writer, batch)
            except Conflict:
                continue
        raise Conflict(f"{self.path}: {tries} versions of other writers came first")

    def compact(self, keys: Sequence[str], order: Sequence[str]) -> int:
        """A new version of an appended table that holds the newest row of each key alone."""
        parent = self.manifest()
        schema = T.StructType.fromJson(parent["schema"])
        newest = last_per_key(self._frame(parent), list(keys), list(order)).select(*schema.names)
        _, files = self._stage(newest, by_bucket=False)
        return self._commit(parent, files, schema, [], 0, None, None)

    def upsert(self, changes: DataFrame, keys: Sequence[str], order: Sequence[str] = (), buckets: int = 64,
               writer: str | None = None, batch: int | None = None, tries: int = 5) -> int:
        """A new version in which each key has its newest row (largest ``order``; without one the
        later batch wins).

        ``changes`` is evaluated once.  Only the buckets it touches are read and written
        again; of the others the manifest takes over the files.  ``buckets``
        counts for a new table; it is fixed from then on.  A batch of ``writer`` that the
        table has already applied changes nothing.
        """
        held = None
        for _ in range(tries):
            parent = self.manifest()
            if parent and batch is not None and parent["batches"].get(writer, -1) >= batch:
                return parent["version"]
            n = parent["buckets"] if parent else buckets
            if parent and (not n or parent["keys"] != list(keys)):
                raise ValueError(f"{self.path} is not a table with the keys {keys}")
            if held is None:
                by = list(order) or [BATCH]
                changed = changes if order else changes.withColumn(BATCH, F.lit(batch or 0).cast("long"))
                held = written(changed.withColumn(BUCKET, bucket_of(keys, n)), "upsert")
            touched = {r[0] for r in held.select(BUCKET).distinct().collect()}   # at most n numbers
            if not touched and parent:
                return parent["version"]
            rows = held
            if parent:
                rows = self._frame(parent, touched).unionByName(held)
            merged = last_per_key(rows, list(keys), by).select(*held.columns)
            _, files = self._stage(merged, by_bucket=True)
            kept = [f for f in parent["files"] if f[0] not in touched] if parent else []
            schema = T.StructType([f for f in held.schema.fields if f.name != BUCKET])
            try:
                return self._commit(parent, kept + files, schema, keys, n, writer, batch)
            except Conflict:
                continue   # another writer was faster: once more, on top of its version
        raise Conflict(f"{self.path}: {tries} versions of other writers came first")

    def vacuum(self, keep: int = 2, grace_seconds: float = 86_400) -> int:
        """Remove all but the newest ``keep`` versions, and data that no version left names and
        that is older than the grace time (writers may be at work); returns the number of folders removed."""
        fs, known = self._fs(), self.versions()
        for version in known[:-keep]:
            fs.delete(self._at(f"_versions/{version:012d}.json"), False)
        named = {f.split("/")[1] for v in known[-keep:] for _, f in self.manifest(v)["files"]}
        before = (time.time() - grace_seconds) * 1000
        gone = 0
        for name in self._names("data"):
            if name not in named and fs.getFileStatus(self._at(f"data/{name}")).getModificationTime() <= before:
                fs.delete(self._at(f"data/{name}"), True)
                gone += 1
        return gone
