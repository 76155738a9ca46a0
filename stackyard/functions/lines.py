"""Line-oriented edits of a text value.

Two forms:

* Column form (``*_text``): the text is split into an array of lines and
  rewritten with higher-order functions inside the row.  A document never
  leaves its task, so an edit costs no shuffle and stays in codegen.
* Row form (``lines`` / ``unlines``): one row per line with a 1-based
  ``line_no``, for queries that join or aggregate over lines.  ``unlines``
  rebuilds texts by ordered concatenation per document (one shuffle).

Lines are split on LF, and a CR before the LF is dropped (CRLF files).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_BREAK = r"\r?\n"


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def split_lines(text) -> Column:
    return F.split(_c(text), LINE_BREAK)


def join_lines(arr: Column) -> Column:
    return F.array_join(arr, "\n")


def delete_lines_text(text, pattern: str) -> Column:
    """drop every line matching ``pattern`` (``sed /p/d``)."""
    return join_lines(F.filter(split_lines(text), lambda ln: ~ln.rlike(pattern)))


def comment_out_text(text, pattern: str, marker: str = "#") -> Column:
    """Prefix matching lines with ``marker``."""
    return join_lines(F.transform(
        split_lines(text),
        lambda ln: F.when(ln.rlike(pattern), F.concat(F.lit(marker), ln)).otherwise(ln)))


def insert_after_text(text, pattern: str, new_line: str) -> Column:
    """Insert ``new_line`` after every line matching ``pattern``."""
    return join_lines(F.flatten(F.transform(
        split_lines(text),
        lambda ln: F.when(ln.rlike(pattern), F.array(ln, F.lit(new_line))).otherwise(F.array(ln)))))


def drop_after_text(text, pattern: str) -> Column:
    """Drop every line whose previous line matches ``pattern`` (the
    ``n=$(sed -n /p/=); sed "$((n+1))d"`` edit, applied to each match)."""
    # beside each line the one before, from a second array: the split inside the lambda would
    # run again for each line.  A dropped line is null, as is what fills up the shorter array
    arr = split_lines(text)
    before = F.concat(F.array(F.lit(None).cast("string")), arr)
    return join_lines(F.zip_with(
        arr, before, lambda ln, prev: F.when(prev.isNull() | ~prev.rlike(pattern), ln)))


def lines(df: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None) -> DataFrame:
    """Row form: ``(id, line_no, line)`` with 1-based ``line_no``."""
    extra = [F.col(k) for k in (keep or [])]
    return df.select(F.col(id_col), *extra,
                     F.posexplode(split_lines(text_col)).alias("_pos", "line")) \
             .select(id_col, *(keep or []), (F.col("_pos") + 1).alias("line_no"), "line")


def find_lines(df: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    """Positions of lines matching ``pattern`` (``grep -n``)."""
    return lines(df, id_col, text_col).where(F.col("line").rlike(pattern))


def unlines(line_rows: DataFrame, id_col: str, line_col: str = "line",
            order_col: str = "line_no", out_col: str = "text") -> DataFrame:
    """Rebuild one text per id from line rows, in ``order_col`` order."""
    return (line_rows.groupBy(id_col)
            .agg(F.sort_array(F.collect_list(F.struct(order_col, line_col))).alias("_l"))
            .select(id_col, join_lines(F.col("_l")[line_col]).alias(out_col)))


# Row form of the edits, on ``lines`` output.  A document's lines come from
# one text value, so a window per document is bounded by that value.

def comment_out(line_rows: DataFrame, pattern: str, marker: str = "#",
                line_col: str = "line") -> DataFrame:
    """O7 on line rows."""
    ln = F.col(line_col)
    return line_rows.withColumn(line_col, F.when(ln.rlike(pattern), F.concat(F.lit(marker), ln))
                                .otherwise(ln))


def drop_after(line_rows: DataFrame, pattern: str, id_col: str, line_col: str = "line",
               order_col: str = "line_no") -> DataFrame:
    """O6 on line rows: drop each line whose previous line matches."""
    from pyspark.sql import Window
    prev = F.lag(line_col).over(Window.partitionBy(id_col).orderBy(order_col))
    return (line_rows.withColumn("_prev", prev)
            .where(F.col("_prev").isNull() | ~F.col("_prev").rlike(pattern)).drop("_prev"))


def insert_after(line_rows: DataFrame, pattern: str, new_line: str, id_col: str,
                 line_col: str = "line", order_col: str = "line_no") -> DataFrame:
    """O5 on line rows: a new line after each match; ``line_no`` is
    renumbered 1.. per document."""
    from pyspark.sql import Window
    ln = F.col(line_col)
    grown = line_rows.select(
        "*", F.posexplode(F.when(ln.rlike(pattern), F.array(ln, F.lit(new_line)))
                          .otherwise(F.array(ln))).alias("_sub", "_new"))
    w = Window.partitionBy(id_col).orderBy(order_col, "_sub")
    return (grown.withColumn(order_col, F.row_number().over(w))
            .withColumn(line_col, F.col("_new")).drop("_sub", "_new"))
