"""O1-O3, O8 (explode, ordinals, listing order) and A1-A8 (aggregations)."""

from pyspark.sql import functions as F

from stackyard.functions.strings import exact_avg
from stackyard.operators import aggregates as A
from stackyard.operators.ordinal import desc, ordinal
from stackyard.plans.registry import query
from stackyard.tables import load

# ZooKeeper's client port and its peer and election ports, the
# usual suffixes of a quorum connect string and of a server list line.
CLIENT_PORT = ":2181"
PEER_PORTS = ":2888:3888"


@query("o1_split_explode", "O1", sql="""
SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part
""")
def o1_split_explode(spark, sf):
    return load(spark, sf, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("token"))


@query("o2_indexed_explode", "O2", sql="""
WITH a AS (SELECT p_partkey, string_split(p_name, ' ') AS arr FROM part)
SELECT p_partkey, CAST(unnest(generate_series(0, len(arr) - 1)) AS INTEGER) AS pos,
       unnest(arr) AS token FROM a
""")
def o2_indexed_explode(spark, sf):
    return load(spark, sf, "part").select(
        "p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "token"))


@query("o3_ordinal_ids", "O3", sql="""
SELECT s_nationkey, s_suppkey,
       row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) - 1 AS server_id,
       'server.' || CAST(row_number() OVER (PARTITION BY s_nationkey
                                             ORDER BY s_acctbal DESC, s_suppkey) - 1 AS VARCHAR)
         || '=' || s_name || ':2888:3888' AS server_line
FROM supplier
""")
def o3_ordinal_ids(spark, sf):
    sup = load(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_name", "s_acctbal")
    ids = ordinal(sup, ["s_nationkey"], [desc("s_acctbal"), "s_suppkey"],
                  out="server_id")
    return ids.select("s_nationkey", "s_suppkey", "server_id",
                      F.concat(F.lit("server."), F.col("server_id").cast("string"), F.lit("="),
                               "s_name", F.lit(PEER_PORTS)).alias("server_line"))


@query("o8_first_in_listing", "O8", sql="""
SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 1
""")
def o8_first_in_listing(spark, sf):
    # head -1 of a sorted listing: the limit is the feature (per-task top-1, then merge)
    return load(spark, sf, "part").select("p_partkey", "p_name") \
        .orderBy("p_name", "p_partkey").limit(1)


@query("a1_ordered_concat", "A1", sql="""
SELECT r_regionkey, r_name, string_agg(n_name || ':2181', ',' ORDER BY n_nationkey) AS quorum
FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name
""")
def a1_ordered_concat(spark, sf):
    nat = load(spark, sf, "nation")
    reg = load(spark, sf, "region")
    j = nat.join(reg, nat.n_regionkey == reg.r_regionkey)
    return A.ordered_concat(j, ["r_regionkey", "r_name"], F.concat("n_name", F.lit(CLIENT_PORT)),
                            ["n_nationkey"], ",", out="quorum")


@query("a1_concat_parts", "A1", sql="""
WITH v AS (SELECT o_orderpriority, o_orderkey, ',' || o_orderkey AS v FROM orders),
b AS (SELECT *, (SUM(length(v)) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - length(v)) // 4096 AS part FROM v)
SELECT o_orderpriority, CAST(part AS BIGINT) AS part,
       CASE WHEN part = 0 THEN substr(string_agg(v, '' ORDER BY o_orderkey), 2)
            ELSE string_agg(v, '' ORDER BY o_orderkey) END AS joined
FROM b GROUP BY o_orderpriority, part
""")
def a1_concat_parts(spark, sf):
    # five keys hold all orders: the list of a key comes in parts of 4 KB
    o = load(spark, sf, "orders").select("o_orderpriority", "o_orderkey")
    return A.concat_parts(o, ["o_orderpriority"], "o_orderkey", ["o_orderkey"], part_bytes=4096)


@query("a2_ordered_fold", "A2", sql="""
SELECT s_nationkey, ':' || string_agg(s_name, ':' ORDER BY s_name, s_suppkey) AS classpath
FROM supplier GROUP BY s_nationkey
""")
def a2_ordered_fold(spark, sf):
    sup = load(spark, sf, "supplier")
    return A.ordered_concat(sup, ["s_nationkey"], "s_name", ["s_name", "s_suppkey"], ":",
                            lead=True, out="classpath")


@query("a3_all_of", "A3", sql="""
SELECT l_orderkey, bool_and(l_linestatus = 'F') AS all_final, COUNT(*) AS n_lines
FROM lineitem GROUP BY l_orderkey
""")
def a3_all_of(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.bool_and(F.col("l_linestatus") == "F").alias("all_final"),
        F.count(F.lit(1)).alias("n_lines"))


@query("a4_any_of", "A4", sql="""
SELECT user_id, bool_or(event_type = 'error') AS had_error FROM events GROUP BY user_id
""")
def a4_any_of(spark, sf):
    return load(spark, sf, "events").groupBy("user_id").agg(
        F.bool_or(F.col("event_type") == "error").alias("had_error"))


@query("a5_first_per_key", "A5", sql="""
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
  FROM orders) WHERE rn = 1
""")
def a5_first_per_key(spark, sf):
    o = load(spark, sf, "orders")
    return A.first_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"],
                           ["o_orderkey", "o_orderdate", "o_totalprice"])


@query("a6_last_per_key", "A6", sql="""
SELECT user_id, event_id, ts, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1
""")
def a6_last_per_key(spark, sf):
    e = load(spark, sf, "events")
    return A.last_per_key(e, ["user_id"], ["ts", "event_id"],
                          ["event_id", "ts", "event_type", "value"])


@query("a7_status_report", "A7", sql="""
SELECT CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
            THEN 'present' ELSE 'missing' END AS status, COUNT(*) AS n
FROM orders GROUP BY 1
""")
def a7_status_report(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey")
    li = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return A.status_report(o, li, ["o_orderkey"])


@query("a8_telemetry_rollup", "A8", sql="""
SELECT date_trunc('hour', ts) AS window_start, event_type, COUNT(*) AS n,
       MIN(value) AS v_min, MAX(value) AS v_max,
       floor((2 * CAST(round(SUM(value) * 100) AS BIGINT) * 10000 + COUNT(*)) / (2 * COUNT(*)))
         / 1000000 AS v_avg,
       list_sort(list(value))[CAST(greatest(1, ceil(0.5 * COUNT(*))) AS BIGINT)] AS p50,
       list_sort(list(value))[CAST(greatest(1, ceil(0.95 * COUNT(*))) AS BIGINT)] AS p95
FROM events GROUP BY 1, 2
""")
def a8_telemetry_rollup(spark, sf):
    r = A.telemetry_rollup(load(spark, sf, "events"), ["event_type"], "ts", "value", "1 hour")
    # average rounded half up to 6 decimals exactly (values have 2 decimals)
    return r.withColumn("v_avg", exact_avg("v_sum", "n")).drop("v_sum")
