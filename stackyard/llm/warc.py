"""WARC archives with an index, and reads of selected records by byte ranges.

``write_archive`` frames each row as one WARC/1.1 record, each record one gzip
member, in archive files of bounded size under a shared folder.  What it
returns is the index: per record the file, offset, length, url and digest.
The index is written by Spark's committer, and only files that it names count:
a task that is repeated after a lost executor writes files of new names, and
what its first try left is never read.

Rows with equal payloads (equal SHA-1) are stored once: the row with the
largest id is a ``response``, the others are ``revisit`` records without a
payload that name it.  Rows that repeat that largest id with the same payload
are responses too, as is every row below ``min_bytes`` and every row of a group
whose ids are all null; a null id otherwise counts as smaller than any other.

``read_records`` goes from index rows to records: the rows are ordered by file
and offset, neighbours less than ``GAP`` bytes apart become one range read of at
most ``RANGE`` bytes (one record at least), and each record is cut out of it.
The ranges of one file may be read by several tasks.

Null payloads are empty.  Control characters and blanks of an url are written
percent-encoded in the header, and so is ``%``; a null url has no header, and comes back as null.  An
empty table gives no file and an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import unquote_to_bytes

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackyard.llm.common import saved, shuffle_partitions
from stackyard.session import scratch_path

ARCHIVE_BYTES = 64 << 20   # an archive file is closed beyond this
ARCHIVE_RECORDS = 20_000   # and beyond so many records, whose index rows a task holds
GAP = 64 << 10             # bytes between two records that are read over
RANGE = 8 << 20            # a range read ends before it grows beyond this
TASK_BYTES = 32 << 20      # of archives read by one task
OUT_BYTES = 8 << 20

INDEX = ("id bigint, url string, record_type string, payload_digest string, refers_to bigint, "
         "file string, offset bigint, length bigint")
RECORD = ("id bigint, url string, record_type string, payload_digest string, refers_to bigint, "
          "payload_bytes bigint, intact boolean, payload binary")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(rb"[\x00-\x20%\x7f]")


def filesystem(uri: str):
    """``(file system, path)`` of a folder on storage that driver and executors share."""
    from pyarrow import fs
    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def record_id(key: int | None, digest: str) -> str:
    """The id of the response of a row, the same wherever it is computed."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{key}:{digest}')}>"


def _safe(url: str) -> bytes:
    return _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url.encode("utf-8", "surrogatepass"))


def framed(key: int | None, url: str | None, digest: str, payload: bytes, target: int | None,
           revisit: bool, date: str) -> bytes:
    """One record: header fields, block and end."""
    fields = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response")]
    own = f"<urn:uuid:{uuid.uuid4()}>" if revisit else record_id(key, digest)
    fields += [f"WARC-Record-ID: {own}".encode(), f"WARC-Date: {date}".encode()]
    if url is not None:
        fields.append(b"WARC-Target-URI: " + _safe(url))
    if key is not None:
        fields.append(b"X-Row-ID: %d" % key)
    fields.append(f"WARC-Payload-Digest: sha1:{digest}".encode())
    if revisit:
        fields += [f"WARC-Profile: {PROFILE}".encode(), f"WARC-Refers-To: {record_id(target, digest)}".encode(),
                   b"X-Refers-To-Row-ID: %d" % target]
        block = b""
    else:
        block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n"
                 % len(payload)) + payload
    fields += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(fields) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(record: bytes) -> tuple:
    """``(id, url, type, digest, refers_to, payload)`` of one record; the payload of a revisit is None."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version != b"WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(b": ", 1) for line in lines)
    block = rest[:int(fields[b"Content-Length"])]
    kind = fields[b"WARC-Type"].decode()
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    key, target = fields.get(b"X-Row-ID"), fields.get(b"X-Refers-To-Row-ID")
    url = fields.get(b"WARC-Target-URI")
    return (None if key is None else int(key), None if url is None else unquote_to_bytes(url).decode("utf-8", "surrogatepass"),
            kind, fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:"), None if target is None else int(target), payload)


def _batch(rows: list[tuple], kinds: str):
    import pyarrow as pa
    types = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, columns = [f.split() for f in kinds.split(", ")], list(zip(*rows)) or [()] * (kinds.count(",") + 1)
    return pa.record_batch([pa.array(c, types[t]) for c, (_, t) in zip(columns, names)], names=[n for n, _ in names])


def _writer(root: str, date: str, level: int):
    def member(record: bytes) -> bytes:
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        return packer.compress(record) + packer.flush()

    def run(batches):
        fs, base = filesystem(root)
        out, path, offset, rows = None, "", 0, []
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("id", "url", "html", "sha", "shared", "top"))):
                key, url, html, sha, shared, top = (x.as_py() for x in row)
                if out is None:
                    fs.create_dir(base, recursive=True)
                    path, offset, rows = f"{uuid.uuid4().hex}.warc.gz", 0, []
                    out = fs.open_output_stream(f"{base}/{path}", compression=None)
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                revisit = bool(shared) and top is not None and key != top
                data = member(framed(key, url, digest, html.encode("utf-8", "surrogatepass"),
                                     top if revisit else None, revisit, date))
                out.write(data)
                rows.append((key, url, "revisit" if revisit else "response", digest, top if revisit else None,
                             path, offset, len(data)))
                offset += len(data)
                if offset >= ARCHIVE_BYTES or len(rows) >= ARCHIVE_RECORDS:
                    out.close()   # whole on the storage before the index names it
                    out = None
                    yield _batch(rows, INDEX)
        if out is not None:
            out.close()
            yield _batch(rows, INDEX)
    return run


def write_archive(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z",
                  level: int = 6) -> DataFrame:
    """Archive every row under ``root``; returns the index, itself a written table.

    ``pages`` is read twice: for the payloads that occur more than once, and to
    write.  Those groups are counted map-side and written, so that the join with
    them is between two files, whose hot keys Spark splits (or broadcasts the
    groups when they are small).
    """
    src = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                       F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).alias("html"))
    src = src.withColumn("sha", F.sha1("html"))
    groups = (src.where(F.octet_length("html") >= min_bytes).groupBy("sha")
              .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).where("n > 1"))
    groups = saved(groups.select(F.col("sha").alias("g"), "top", F.lit(True).alias("shared")), "warc-groups")
    marked = src.join(groups, F.col("sha") == F.col("g"), "left").drop("g")
    return saved(marked.mapInArrow(_writer(root, date, level), INDEX), "warc-index")


def ranges(places: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Sorted ``(offset, length)`` as ``(first, last + 1, start, end)``: rows read by one range read."""
    out: list[tuple[int, int, int, int]] = []
    for i, (offset, length) in enumerate(places):
        end = offset + length
        if out and offset - out[-1][3] <= GAP and max(end, out[-1][3]) - out[-1][2] <= RANGE:
            first, _, start, before = out[-1]
            out[-1] = (first, i + 1, start, max(end, before))
        else:
            out.append((i, i + 1, offset, end))
    return out


def _reader(root: str, payloads: bool):
    def run(batches):
        fs, base = filesystem(root)
        out, size, name, file = [], 0, None, None
        for batch in batches:
            files, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            start = 0
            while start < len(files):
                end = start + 1
                while end < len(files) and files[end] == files[start]:
                    end += 1
                if files[start] != name:
                    if file is not None:
                        file.close()
                    name = files[start]
                    file = fs.open_input_file(f"{base}/{name}")
                places = list(zip(offsets[start:end], lengths[start:end]))
                for first, last, low, high in ranges(places):
                    data = file.read_at(high - low, low)
                    for offset, length in places[first:last]:
                        member = data[offset - low:offset - low + length]
                        *head, payload = parsed(zlib.decompress(member, 31))
                        whole = payload is None or base64.b32encode(hashlib.sha1(payload).digest()).decode() == head[3]
                        n = None if payload is None else len(payload)
                        out.append((*head, n, whole, payload if payloads else None))
                        size += 200 + (n or 0) * payloads
                        if size > OUT_BYTES:
                            yield _batch(out, RECORD)
                            out, size = [], 0
                start = end
        if file is not None:
            file.close()
        yield _batch(out, RECORD)
    return run


def read_records(index: DataFrame, root: str, payloads: bool = True) -> DataFrame:
    """The records of the index rows given (a selection of them, by url or digest, as a user likes).

    ``payload_bytes`` and ``payload`` are null for a revisit; ``intact`` says
    that the payload has the digest of its header.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    n = max(shuffle_partitions(index.sparkSession), -(-total // TASK_BYTES))
    places = index.select("file", "offset", "length").repartitionByRange(n, "file", "offset")
    return places.sortWithinPartitions("file", "offset").mapInArrow(_reader(root, payloads), RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` (a written table) with the size of the full payload, a revisit's from its response."""
    light = records.select("id", "url", "record_type", "payload_digest", "refers_to", "payload_bytes", "intact")
    sizes = saved(light.where("record_type = 'response' AND id IS NOT NULL").groupBy("id", "payload_digest").agg(
        F.max("payload_bytes").alias("full")), "warc-sizes")
    first = light.where("record_type = 'response'")
    again = light.where("record_type = 'revisit'").alias("r").join(
        sizes.alias("s"), F.expr("r.refers_to = s.id AND r.payload_digest = s.payload_digest"), "left").select(
        *[F.coalesce("s.full", "r.payload_bytes").alias(c) if c == "payload_bytes" else f"r.{c}" for c in light.columns])
    return first.unionByName(again)


def archive_roundtrip(pages: DataFrame, root: str | None = None, id_col: str = "page_id", url_col: str = "url",
                      payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Archive every row, read all records back: ``id_col, url, payload_bytes, payload_digest,
    record_type, refers_to, intact``."""
    root = root or scratch_path(pages.sparkSession, "warc")
    index = write_archive(pages, root, id_col, url_col, payload_col, min_bytes)
    records = saved(read_records(index, root, payloads=False), "warc-records")
    return resolved(records).select(F.col("id").alias(id_col), "url", "payload_bytes", "payload_digest",
                                    "record_type", "refers_to", "intact")
