"""U rows: upsert, append, replace, delete, backup-once."""

from pyspark.sql import functions as F

from stackyard.operators.filters import delete_where
from stackyard.operators.updates import upsert
from stackyard.plans.registry import query
from stackyard.session import scratch_path
from stackyard.sources.sinks import backup_once, replace_table
from stackyard.tables import load


def _customer_changes(spark, sf):
    """Every order is a change to its customer; the newest order wins."""
    o = load(spark, sf, "orders")
    c = load(spark, sf, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.select("c_custkey", "c_name", "c_nationkey",
                    F.round(F.col("c_acctbal") - F.col("o_totalprice") / 100, 4).alias("c_acctbal"),
                    F.col("o_orderpriority").alias("c_mktsegment"),
                    "o_orderdate", "o_orderkey")


@query("u1_keyed_upsert", "U1", sql="""
WITH ch AS (SELECT c_custkey, c_name, c_nationkey, round(c_acctbal - o_totalprice / 100, 4) AS c_acctbal,
                   o_orderpriority AS c_mktsegment,
                   row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
            FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM ch WHERE rn = 1
UNION ALL
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
""")
def u1_keyed_upsert(spark, sf):
    return upsert(load(spark, sf, "customer"), _customer_changes(spark, sf), ["c_custkey"],
                  ["o_orderdate", "o_orderkey"])


@query("u2_append", "U2", sql="""
SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, c_nationkey AS nationkey FROM customer
UNION ALL
SELECT 'supplier' AS kind, s_suppkey AS id, s_name AS name, s_nationkey AS nationkey FROM supplier
""")
def u2_append(spark, sf):
    c = load(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"),
                                           F.col("c_name").alias("name"),
                                           F.col("c_nationkey").alias("nationkey"))
    s = load(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"),
                                           F.col("s_name").alias("name"),
                                           F.col("s_nationkey").alias("nationkey"))
    return c.unionByName(s)


@query("u3_replace_dataset", "U3", sql="""
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'
""")
def u3_replace_dataset(spark, sf):
    # first version: all orders; replacement: orders without status P
    root = scratch_path(spark, "u3")
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    table = replace_table(spark, o, root)
    return replace_table(spark, table.read().where(F.col("o_orderstatus") != "P"), root).read()


@query("u4_delete_where", "U4", sql="""
SELECT event_id, user_id, event_type FROM events
WHERE NOT coalesce(event_type = 'error', false)
""")
def u4_delete_where(spark, sf):
    e = load(spark, sf, "events").select("event_id", "user_id", "event_type")
    return delete_where(e, F.col("event_type") == "error")


@query("u5_backup_once", "U5", sql="""
SELECT r_regionkey, r_name FROM region
""")
def u5_backup_once(spark, sf):
    path = scratch_path(spark, "u5")
    reg = load(spark, sf, "region")
    backup_once(reg, path)
    backup_once(reg.withColumn("r_name", F.lower("r_name")), path)  # ignored: backup exists
    return spark.read.parquet(path)
