import datetime as dt
import decimal
import math


def norm(v, digits=6):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, digits)
    if isinstance(v, decimal.Decimal):
        return round(float(v), digits)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x, digits)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict(recursive=True), digits)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def same(df, cols_rows):
    """Spark frame equals (cols, rows) as a multiset, columns by name."""
    cols, rows = cols_rows
    assert sorted(df.columns) == sorted(cols)
    return rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, rows)
