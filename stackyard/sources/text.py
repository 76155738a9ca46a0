"""Text sources.

Text files are read with ``spark.read.text``: splittable when uncompressed,
so a large file is scanned by many tasks.  A last line without a newline is
kept.  CR before LF is dropped (CRLF files); nothing else is stripped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackyard.functions.strings import literal_pattern
from stackyard.operators.aggregates import first_per_key

CODECS = ("none", "gzip", "bzip2", "deflate", "snappy", "lz4")


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.text(paths).select(F.regexp_replace("value", "\r$", "").alias("line"))


def _body(lines: DataFrame, comment: str | None) -> DataFrame:
    """Drop blank rows and comment rows (first non-blank text is ``comment``)."""
    keep = F.trim("line") != ""
    if comment:
        keep = keep & ~F.ltrim("line").startswith(comment)
    return lines.where(keep)


def _fields(sep: str, collapse: bool):
    line = F.col("line")
    if collapse:  # runs of the separator count as one, as `echo $line | cut` sees them
        return F.split(F.trim(line) if sep == " " else line, literal_pattern(sep) + "+")
    return F.split(line, literal_pattern(sep))


def read_delimited(spark: SparkSession, path, schema: T.StructType | Sequence[str],
                   sep: str = " ", comment: str | None = "#",
                   collapse: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """IO1: positional fields of each line.

    Runs of the separator count as one where ``collapse`` is set; by default
    that holds for blanks only, so ``a,,c`` keeps its empty field.

    Returns ``(rows, rejects)``.  ``rows`` holds every non-blank,
    non-comment line with its fields (NULL when missing, and NULL for all
    fields when the separator is absent, never the whole line), the raw
    ``line`` and a ``complete`` flag; values that do not cast to the schema
    type become NULL (``try_cast``).  ``rejects`` is the incomplete part.
    """
    rows = _delimited(_lines(spark, path), schema, sep, comment, collapse)
    return rows, rows.where(~F.col("complete"))


def _delimited(lines: DataFrame, schema, sep: str, comment: str | None, collapse: bool | None,
               keep: Sequence[str] = ()) -> DataFrame:
    if not isinstance(schema, T.StructType):
        schema = T.StructType([T.StructField(n, T.StringType()) for n in schema])
    collapse = sep == " " if collapse is None else collapse
    parts = _fields(sep, collapse)
    has_sep = F.instr(F.trim("line") if (collapse and sep == " ") else F.col("line"), sep) > 0
    cols = []
    for i, f in enumerate(schema.fields):
        v = F.when(has_sep, F.get(parts, i))
        cols.append((v if isinstance(f.dataType, T.StringType) else v.try_cast(f.dataType))
                    .alias(f.name))
    complete = has_sep & (F.size(parts) >= len(schema.fields))
    return _body(lines, comment).select(*cols, "line", complete.alias("complete"), *keep)


def _properties(lines: DataFrame, sep: str, comment: str, end_marker: str | None,
                keep: Sequence[str] = ()) -> DataFrame:
    rows = _delimited(lines, ["key", "value", "_marker"], sep, comment, None, keep)
    value = F.col("value")
    if end_marker is not None:
        value = F.when(value == end_marker, F.lit(None)).otherwise(value)
    no_sep = F.instr(F.trim("line"), sep) == 0
    return rows.select(F.when(no_sep, F.trim("line")).otherwise(F.col("key")).alias("key"),
                       value.alias("value"), *keep)


def numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``(file, line_no, line)`` of text files, lines counted from 1 per file however the files are split.

    A file is read by many tasks, each a block of it.  Rows of a task are
    numbered as they are read, so within a block a line's place is its number less
    the smallest one there, and a block begins after the lines of the blocks before
    it: one row per block, added up per file.  No file goes through one
    task.  Blocks and numbers come from the scan itself, the same in both reads of it.
    """
    paths = [path] if isinstance(path, str) else list(path)
    rows = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))
    blocks = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(F.col("file").alias("_file"), F.col("block").alias("_block"), "first",
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before"))
    return rows.join(starts, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))).select(
        "file", (F.col("lines_before") + F.col("at") - F.col("first") + 1).alias("line_no"), "line")


def read_properties(spark: SparkSession, path, sep: str = " ", comment: str = "#",
                    end_marker: str | None = "END") -> DataFrame:
    """IO2: ``key value [END]`` rows as ``(key, value)``.

    The optional end marker is dropped; a key with no value gets NULL.  A
    key may appear more than once; every row is kept (lookups decide).
    """
    return _properties(_lines(spark, path), sep, comment, end_marker)


def lookup_properties(spark: SparkSession, path, keys: Sequence[str] | None = None, per_file: bool = False,
                      sep: str = " ", comment: str = "#", end_marker: str | None = "END") -> DataFrame:
    """IO2: the value of each property, ``(key, value, file, line_no)``: of lines that repeat a key the
    first wins, in the order of file names and line numbers (``per_file``: the first of each file).

    ``keys`` asks for some properties only.  A first line without a value answers NULL;
    a key that no line has gives no row.
    """
    props = _properties(numbered_lines(spark, path), sep, comment, end_marker, ["file", "line_no"])
    if keys is not None:
        props = props.where(F.col("key").isin(list(keys)))
    by = ["key", "file"] if per_file else ["key"]
    return first_per_key(props, by, ["file", "line_no"], [c for c in ("value", "file", "line_no") if c not in by]).select(
        "key", "value", "file", "line_no")


def list_files(spark: SparkSession, root: str, glob: str = "*",
               recursive: bool = True) -> DataFrame:
    """IO3: ``(path, name, length, modificationTime)`` of files under
    ``root`` matching ``glob``.  The ``content`` column is never selected,
    so no file body is read."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
          .option("recursiveFileLookup", str(recursive).lower()).load(root))
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"),
                     "length", "modificationTime")


def _escaped(name: str):
    x = F.replace(F.col(f"`{name}`"), F.lit("\\"), F.lit("\\\\"))
    x = F.replace(F.replace(x, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return x.alias(name)


def _unescaped(name: str):
    # between pairs of backslashes, each an escaped one, \\n and \\r are line breaks
    breaks = lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    parts = F.transform(F.split(F.col(f"`{name}`"), r"\\\\", -1), breaks)
    return F.array_join(parts, "\\").alias(name)


def write_text(df: DataFrame, path: str, codec: str = "none", sep: str = ",",
               mode: str = "errorifexists") -> None:
    """IO6: delimited text with a compression codec.  gzip and deflate files
    cannot be split on read (one task per file); bzip2 can.  LZO is not
    shipped with Spark and is refused here.  A line break inside a value is
    written as ``\\n`` or ``\\r`` (and a backslash doubled), so each row is one line;
    ``read_text`` undoes it."""
    if codec not in CODECS:
        raise ValueError(f"codec must be one of {CODECS}")
    df = df.select(*[_escaped(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
                     for f in df.schema])
    (df.write.mode(mode).option("compression", codec).option("sep", sep)
     .option("header", "false").csv(path))


def read_text(spark: SparkSession, path, schema: T.StructType | str, sep: str = ",") -> DataFrame:
    """IO6: read delimited text; the codec is taken from the file suffix."""
    raw = spark.read.schema(schema).option("sep", sep).option("mode", "PERMISSIVE").csv(path)
    return raw.select(*[_unescaped(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
                        for f in raw.schema])
