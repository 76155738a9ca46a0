"""Databases and scripts, in a fresh warehouse folder."""

import os
import uuid

from stackyard.operators.catalog import create_database, drop_database, run_script, split_statements


def test_split_statements_respects_quotes_and_comments():
    script = "SELECT ';' AS a; -- a comment; with semicolons\nSELECT \"x;y\" AS b;\n\n;SELECT 1"
    assert split_statements(script) == ["SELECT ';' AS a", "SELECT \"x;y\" AS b", "SELECT 1"]


def test_create_and_drop_database(spark, tmp_dir):
    name = f"sy_{uuid.uuid4().hex[:8]}"
    drop_database(spark, name)                       # absent: no error (first run)
    create_database(spark, name, os.path.join(tmp_dir, "db"))
    create_database(spark, name)                     # present: no error
    names = [r[0] for r in spark.sql("SHOW DATABASES").collect()]
    assert name in names
    run_script(spark, f"CREATE TABLE {name}.t USING parquet AS SELECT 1 AS x; "
                      f"INSERT INTO {name}.t SELECT 2")
    assert spark.table(f"{name}.t").count() == 2
    drop_database(spark, name)
    assert name not in [r[0] for r in spark.sql("SHOW DATABASES").collect()]
