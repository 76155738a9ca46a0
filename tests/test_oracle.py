"""Every registered query against its DuckDB oracle on the smallest tables."""

import re

import pytest

from helpers import rows_of
from conftest import SMALL

import __spark_entry__ as E

SQL = E.oracle_sql()
QUERIES = E.queries()


def test_every_query_of_the_library_has_an_oracle():
    library = {n for n in QUERIES if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert library <= set(SQL)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["day", "active_users", "new_users", "n_events"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    cols = df.columns
    got = rows_of(cols, [tuple(r) for r in df.collect()])
    cur = duck.execute(SQL[name])
    ocols = [d[0] for d in cur.description]
    exp = rows_of(ocols, cur.fetchall())
    assert sorted(cols) == sorted(ocols)
    assert len(got) == len(exp)
    assert got == exp
