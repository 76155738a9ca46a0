import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from stackyard.session import clear_scratch, make_session
    s = make_session(4, shuffle_partitions=8, app="stackyard-tests")
    yield s
    clear_scratch(s)
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb
    from stackyard.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.fixture()
def tmp_dir(tmp_path):
    return str(tmp_path)
