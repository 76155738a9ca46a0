"""Scalar string helpers.  All return Columns built from
Spark built-ins, so they stay inside whole-stage codegen.

Semantics fixed here (SURVEY 2.12): a missing field is NULL, never the whole
line; separators are literal unless a ``*_regex`` argument is used.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literal_pattern(sep: str) -> str:
    """Java-regex pattern that matches ``sep`` literally (for ``split``)."""
    return re.escape(sep)


def field(x: ColumnOrName, n: int, sep: str = " ") -> Column:
    """1-based field ``n`` of ``x`` split on literal ``sep``; NULL when missing
    or when ``sep`` does not occur at all (unlike ``cut``, which returns the
    whole line)."""
    x = _c(x)
    return F.when(F.instr(x, sep) > 0, F.get(F.split(x, literal_pattern(sep)), n - 1))


def split_field(x: ColumnOrName, sep: str, n: int) -> Column:
    """``split_part`` semantics: 1-based, empty string when out of range."""
    return F.split_part(_c(x), F.lit(sep), F.lit(n))


def before(x: ColumnOrName, sep: str) -> Column:
    """Text before the first literal ``sep`` (whole text if absent)."""
    return F.substring_index(_c(x), sep, 1)


def strip_ws(x: ColumnOrName) -> Column:
    """``x`` without leading and trailing white space of any kind (``trim`` takes blanks only)."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def ws_fields(x: ColumnOrName) -> Column:
    """Whitespace-separated fields of ``x`` (runs of white space are one separator)."""
    return F.split(strip_ws(x), r"\s+")


def last_ws_field(x: ColumnOrName) -> Column:
    """Last whitespace field (``awk '{print $NF}'``)."""
    return F.element_at(ws_fields(x), -1)


def nth_ws_field(x: ColumnOrName, n: int) -> Column:
    """1-based whitespace field, NULL when missing (``awk '{print $n}'``)."""
    return F.get(ws_fields(x), n - 1)


def replace_first(x: ColumnOrName, old: str, new: str) -> Column:
    """Replace the first literal occurrence of ``old``."""
    x = _c(x)
    pos = F.instr(x, old)
    tail = x.substr(pos + F.lit(len(old)), F.lit(2**31 - 1))
    return F.when(pos > 0, F.concat(F.substring_index(x, old, 1), F.lit(new), tail)).otherwise(x)


def replace_all(x: ColumnOrName, old: str, new: str) -> Column:
    """X6 (one pair): literal replace of every occurrence."""
    return F.replace(_c(x), F.lit(old), F.lit(new))


def render(template: ColumnOrName, params: ColumnOrName) -> Column:
    """Substitute every ``key`` of the map column ``params`` by its value
    in ``template``, keys applied in sorted order (a left fold with
    ``aggregate``; no Python)."""
    entries = F.array_sort(F.map_entries(_c(params)))
    return F.aggregate(entries, _c(template).cast("string"),
                       lambda acc, e: F.replace(acc, e["key"], e["value"]))


def replace_keep_match(x: ColumnOrName, pattern: str, suffix: str = "", prefix: str = "") -> Column:
    """Regex replace that keeps the whole match (sed ``&``) between a
    prefix and a suffix."""
    return F.regexp_replace(_c(x), pattern, prefix.replace("$", r"\$") + "$0"
                            + suffix.replace("$", r"\$"))


def from_offset(x: ColumnOrName, start: int) -> Column:
    """Substring from 1-based ``start`` to the end."""
    return F.substring(_c(x), start, 2**31 - 1)


def collapse_ws(x: ColumnOrName) -> Column:
    """Trim and collapse every whitespace run to one blank (unquoted echo)."""
    return F.regexp_replace(strip_ws(x), r"\s+", " ")


def member_of(node: ColumnOrName, csv_list: ColumnOrName, sep: str = ",") -> Column:
    """exact membership of ``node`` in a separated list (``node1`` is not a
    member of ``node10,node2``; the substring hit of a regex is fixed)."""
    return F.array_contains(F.split(_c(csv_list), literal_pattern(sep)), _c(node))


def exact_avg(total: ColumnOrName, count: ColumnOrName, scale: int = 2, digits: int = 6) -> Column:
    """Average of values with ``scale`` decimals, rounded half up (away from
    zero) to ``digits`` decimals in decimal arithmetic: the sum is taken in
    whole units of ``10**-scale`` first.  Engines that sum doubles in a
    different order then still agree, even when the average falls exactly
    on a rounding tie.  Exact while the scaled sum has at most 38 digits."""
    units = F.round(_c(total) * (10 ** scale)).cast("decimal(30,0)")
    n = _c(count).cast("decimal(20,0)")
    doubled = F.abs(units) * F.lit(2 * 10 ** (digits - scale)).cast("decimal(7,0)")
    half_up = F.call_function("div", doubled + n, n * F.lit(2).cast("decimal(1,0)"))
    return F.signum(units) * (half_up / F.lit(10 ** digits)).cast("double")

