"""K rows over cells derived from ``events``: row key = user, qualifier =
event type, version = (ts, event_id), value = value."""

from pyspark.sql import functions as F

from stackyard.operators import versions as V
from stackyard.plans.registry import query
from stackyard.session import scratch_path
from stackyard.tables import load


def event_cells(spark, sf):
    return load(spark, sf, "events").select(
        F.col("user_id").alias("row_key"), F.col("event_type").alias("qualifier"),
        F.col("ts").alias("version"), "event_id", "value")


@query("k1_latest_version", "K1", sql="""
SELECT user_id AS row_key, event_type AS qualifier, ts AS version, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1
""")
def k1_latest_version(spark, sf):
    return V.latest(event_cells(spark, sf), ["version", "event_id"])


@query("k2_keep_n_versions", "K2", sql="""
SELECT user_id AS row_key, event_type AS qualifier, ts AS version, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn <= 3
""")
def k2_keep_n_versions(spark, sf):
    return V.versions(event_cells(spark, sf), 3, ["version", "event_id"])


@query("k3_range_scan", "K3", sql="""
SELECT 'range' AS scan, c_custkey, c_name FROM customer
WHERE c_name >= 'Customer#000000100' AND c_name < 'Customer#000000200'
UNION ALL
SELECT 'prefix' AS scan, c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#0000010')
""")
def k3_range_scan(spark, sf):
    path = scratch_path(spark, "k3")
    cells = load(spark, sf, "customer").select(F.col("c_name").alias("row_key"), "c_custkey")
    V.write_sorted(cells, path)
    t = spark.read.parquet(path)
    rng = V.scan(t, "Customer#000000100", "Customer#000000200").withColumn("scan", F.lit("range"))
    pre = V.scan(t, prefix="Customer#0000010").withColumn("scan", F.lit("prefix"))
    return rng.unionByName(pre).select("scan", "c_custkey", F.col("row_key").alias("c_name"))


@query("k4_delete_markers", "K4", sql="""
WITH m AS (SELECT user_id, MAX(ts) AS upto FROM events WHERE event_type = 'error' GROUP BY user_id),
     vis AS (SELECT e.* FROM events e LEFT JOIN m ON e.user_id = m.user_id
             WHERE m.upto IS NULL OR e.ts > m.upto)
SELECT user_id AS row_key, event_type AS qualifier, ts AS version, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
  FROM vis) WHERE rn = 1
""")
def k4_delete_markers(spark, sf):
    cells = event_cells(spark, sf)
    # every error event is a whole-row delete marker at its time
    markers = cells.where(F.col("qualifier") == "error").select("row_key", "version")
    return V.latest(V.apply_deletes(cells, markers), ["version", "event_id"])
