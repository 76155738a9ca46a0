"""IO rows and C rows: sources and sinks as round trips through the shared
checkpoint folder.  Every input is derived from the driver's tables, written
with the operator under test, and read back; the oracle computes the same
rows straight from the tables."""

import uuid

from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from stackyard.operators.catalog import run_script
from stackyard.plans.registry import query
from stackyard.session import scratch_path
from stackyard.sources import text as TX
from stackyard.sources.jdbc import import_since, register_sources
from stackyard.sources.sinks import backup_once, overwrite_days, overwrite_days_table, write_table
from stackyard.sources.topic import decode_topic, encode_topic
from stackyard.sources.xml import overlay, read_xml_properties, write_xml_properties
from stackyard.tables import load


@query("io1_read_delimited", "IO1", sql="""
WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
     b AS (SELECT line, regexp_split_to_array(trim(line), ' +') AS p FROM l
           WHERE trim(line) <> '' AND NOT starts_with(ltrim(line), '#'))
SELECT CASE WHEN instr(trim(line), ' ') > 0 THEN p[1] END AS w1,
       CASE WHEN instr(trim(line), ' ') > 0 THEN p[2] END AS w2,
       CASE WHEN instr(trim(line), ' ') > 0 THEN p[3] END AS w3,
       instr(trim(line), ' ') > 0 AND len(p) >= 3 AS complete
FROM b
""")
def io1_read_delimited(spark, sf):
    path = scratch_path(spark, "io1")
    load(spark, sf, "documents").select("text").write.text(path)
    rows, _ = TX.read_delimited(spark, path, ["w1", "w2", "w3"], sep=" ")
    return rows.select("w1", "w2", "w3", "complete")


@query("io2_read_properties", "IO2", sql="""
SELECT 'cust.' || c_custkey AS key, c_name AS value FROM customer
UNION ALL SELECT 'nation.' || n_nationkey AS key, n_name AS value FROM nation
UNION ALL SELECT 'region.' || r_regionkey AS key, NULL AS value FROM region
""")
def io2_read_properties(spark, sf):
    # a properties file with CRLF ends, comment rows, blank rows, an END
    # marker on some rows and none on others, and keys with no value
    c = load(spark, sf, "customer")
    lines = (c.select(F.concat(F.lit("cust."), F.col("c_custkey").cast("string"), F.lit(" "),
                               F.col("c_name"), F.lit(" END\r")).alias("value"))
             .unionByName(c.select(F.concat(F.lit("# segment "), "c_mktsegment", F.lit("\r"))
                                   .alias("value")).distinct())
             .unionByName(load(spark, sf, "nation").select(
                 F.concat(F.lit("nation."), F.col("n_nationkey").cast("string"), F.lit("  "),
                          "n_name").alias("value")))
             .unionByName(load(spark, sf, "region").select(
                 F.concat(F.lit("region."), F.col("r_regionkey").cast("string")).alias("value")))
             .unionByName(load(spark, sf, "region").select(F.lit("\r").alias("value"))))
    path = scratch_path(spark, "io2")
    lines.write.text(path)
    return TX.read_properties(spark, path)


@query("io2_lookup", "IO2", sql="""
SELECT 'cust.' || o_custkey AS key, arg_min(o_orderstatus || o_orderkey, o_orderkey) AS value FROM orders GROUP BY o_custkey
""")
def io2_lookup(spark, sf):
    # every order writes its customer's property again: the first of the repeated lines wins
    line = F.concat(F.lit("cust."), F.col("o_custkey").cast("string"), F.lit(" "), "o_orderstatus",
                    F.col("o_orderkey").cast("string"), F.lit(" END\r"))
    path = scratch_path(spark, "io2l")
    (load(spark, sf, "orders").repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey")
     .select(line.alias("value")).write.text(path))
    return TX.lookup_properties(spark, path).select("key", "value")


@query("io3_list_files", "IO3", sql="""
SELECT DISTINCT CAST(n_regionkey AS VARCHAR) AS region_dir, true AS has_files FROM nation
""")
def io3_list_files(spark, sf):
    root = scratch_path(spark, "io3")
    load(spark, sf, "nation").write.partitionBy("n_regionkey").parquet(root)
    files = TX.list_files(spark, root, "*.parquet")
    d = F.regexp_extract("path", r"n_regionkey=([^/]+)/", 1)
    return files.groupBy(d.alias("region_dir")).agg((F.count(F.lit(1)) > 0).alias("has_files"))


@query("io4_append_overwrite", "IO4", sql="""
SELECT r_regionkey, r_name, 'append' AS mode FROM region
UNION ALL SELECT r_regionkey, r_name, 'append' AS mode FROM region
UNION ALL SELECT r_regionkey, r_name, 'overwrite' AS mode FROM region
""")
def io4_append_overwrite(spark, sf):
    reg = load(spark, sf, "region")
    pa, po = scratch_path(spark, "io4a"), scratch_path(spark, "io4o")
    for _ in range(2):
        write_table(reg, pa, "append")
        write_table(reg, po, "overwrite")
    return (spark.read.parquet(pa).withColumn("mode", F.lit("append"))
            .unionByName(spark.read.parquet(po).withColumn("mode", F.lit("overwrite"))))


@query("io5_ignore_errorifexists", "IO5", sql="""
SELECT r_regionkey, r_name, 'ignore' AS mode, true AS second_refused FROM region
UNION ALL SELECT r_regionkey, r_name, 'errorifexists' AS mode, true AS second_refused FROM region
""")
def io5_ignore_errorifexists(spark, sf):
    reg = load(spark, sf, "region")
    changed = reg.withColumn("r_name", F.lower("r_name"))
    pi, pe = scratch_path(spark, "io5i"), scratch_path(spark, "io5e")
    backup_once(reg, pi)
    backup_once(changed, pi)          # create-if-absent: leaves the first copy
    write_table(reg, pe, "errorifexists")
    try:
        write_table(changed, pe, "errorifexists")
        refused = False
    except AnalysisException:
        refused = True
    return (spark.read.parquet(pi).withColumn("mode", F.lit("ignore"))
            .withColumn("second_refused", F.lit(True))
            .unionByName(spark.read.parquet(pe).withColumn("mode", F.lit("errorifexists"))
                         .withColumn("second_refused", F.lit(refused))))


CODECS = ("none", "gzip", "bzip2", "deflate", "snappy", "lz4")


@query("io6_compressed_text", "IO6", sql="""
SELECT n_nationkey, n_name, n_regionkey, codec FROM nation,
  (VALUES ('none'), ('gzip'), ('bzip2'), ('deflate'), ('snappy'), ('lz4')) c(codec)
""")
def io6_compressed_text(spark, sf):
    nat = load(spark, sf, "nation")
    root = scratch_path(spark, "io6")
    out = None
    for codec in CODECS:
        TX.write_text(nat, f"{root}/{codec}", codec)
        back = TX.read_text(spark, f"{root}/{codec}", nat.schema).withColumn("codec", F.lit(codec))
        out = back if out is None else out.unionByName(back)
    return out


@query("io7_xml_overlay", "IO7", sql="""
SELECT 'nation.' || n_nationkey AS name, n_name AS value, 'region ' || n_regionkey AS description
FROM nation
UNION ALL SELECT 'region.' || r_regionkey AS name, r_name AS value, NULL AS description FROM region
""")
def io7_xml_overlay(spark, sf):
    base = load(spark, sf, "nation").select(
        F.concat(F.lit("nation."), F.col("n_nationkey").cast("string")).alias("name"),
        F.col("n_name").alias("value"),
        F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("description"))
    extra = load(spark, sf, "region").select(
        F.concat(F.lit("region."), F.col("r_regionkey").cast("string")).alias("name"),
        F.col("r_name").alias("value"))
    path = scratch_path(spark, "io7")
    write_xml_properties(base, path)
    # the overlay appends properties next to the existing set (IO4 append)
    write_xml_properties(extra.withColumn("description", F.lit(None).cast("string")), path,
                         mode="append")
    return read_xml_properties(spark, path)


@query("io7_xml_replace", "IO7", sql="""
SELECT 'nation.' || n_nationkey AS name, CASE WHEN n_nationkey < 5 THEN r_name ELSE n_name END AS value,
       CASE WHEN n_nationkey >= 5 THEN 'region ' || n_regionkey END AS description
FROM nation LEFT JOIN region ON n_nationkey = r_regionkey
UNION ALL SELECT 'supplier.' || s_suppkey AS name, s_name AS value, NULL AS description FROM supplier
""")
def io7_xml_replace(spark, sf):
    # a second file names five of the nations again, with other values, and every supplier
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("name")
    base, over = scratch_path(spark, "io7-base"), scratch_path(spark, "io7-over")
    write_xml_properties(load(spark, sf, "nation").select(
        named("nation.", "n_nationkey"), F.col("n_name").alias("value"),
        F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("description")), base)
    write_xml_properties(load(spark, sf, "region").select(named("nation.", "r_regionkey"), F.col("r_name").alias("value"))
                         .unionByName(load(spark, sf, "supplier").select(
                             named("supplier.", "s_suppkey"), F.col("s_name").alias("value"))), over)
    out = scratch_path(spark, "io7-out")
    write_xml_properties(overlay(read_xml_properties(spark, base), read_xml_properties(spark, over), replace=True), out)
    return read_xml_properties(spark, out)


@query("io9_import_since", "IO9", sql="""
SELECT o_orderkey, o_orderdate,
       (SELECT max(o_orderdate) FROM orders WHERE o_orderdate > TIMESTAMP '2000-06-01') AS high_water_mark
FROM orders WHERE o_orderdate > TIMESTAMP '2000-06-01'
""")
def io9_import_since(spark, sf):
    src = load(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    rows, mark = import_since(src, "o_orderdate", F.lit("2000-06-01 00:00:00").cast("timestamp_ntz"))
    return rows.select("o_orderkey", "o_orderdate", mark.scalar().alias("high_water_mark"))


EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, " \
               "value double, props string"


def _corrupt_error_events(rec):
    """The producer of error events drops the closing brace: those values
    are not valid JSON and must land in rejects (the whole value is kept)."""
    text = F.col("value").cast("string")
    is_err = F.get_json_object(text, "$.event_type") == "error"
    return rec.withColumn("value", F.when(is_err, F.regexp_replace(text, "}$", "").cast("binary"))
                          .otherwise(F.col("value")))


@query("io12_decode_topic", "IO12", sql="""
SELECT event_id, ts, user_id, event_type, value, props FROM events WHERE event_type <> 'error'
""")
def io12_decode_topic(spark, sf):
    ev = load(spark, sf, "events")
    rec = _corrupt_error_events(encode_topic(ev, "user_id", "events", partitions=8))
    decoded, _ = decode_topic(rec, EVENT_SCHEMA, keep=())
    return decoded


@query("io12_topic_rejects", "IO12", sql="""
SELECT COUNT(*) AS n_rejects FROM events WHERE event_type = 'error'
""")
def io12_topic_rejects(spark, sf):
    ev = load(spark, sf, "events")
    rec = _corrupt_error_events(encode_topic(ev, "user_id", "events", partitions=8))
    _, rejects = decode_topic(rec, EVENT_SCHEMA, keep=())
    return rejects.agg(F.count(F.lit(1)).alias("n_rejects"))


@query("io13_overwrite_days", "IO13", sql="""
SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n_events FROM events
WHERE CAST(ts AS DATE) <> DATE '2024-01-05' OR event_type <> 'error'
GROUP BY 1
""")
def io13_overwrite_days(spark, sf):
    ev = load(spark, sf, "events").withColumn("day", F.to_date("ts"))
    path = scratch_path(spark, "io13")
    overwrite_days(ev, path, "day")
    overwrite_days(ev, path, "day")  # rerun: idempotent
    day = F.col("day") == F.lit("2024-01-05").cast("date")
    # corrected rerun of one day replaces that day only
    overwrite_days(ev.where(day & (F.col("event_type") != "error")), path, "day")
    back = spark.read.parquet(path)
    return back.groupBy("day").agg(F.count(F.lit(1)).alias("n_events"))


@query("io13_daily_table", "IO13", sql="""
SELECT CAST(ts AS DATE) AS day, event_type, COUNT(*) AS n_events, round(SUM(value), 2) AS total FROM events
WHERE CAST(ts AS DATE) <> DATE '2024-01-05' OR event_type <> 'error'
GROUP BY 1, 2
""")
def io13_daily_table(spark, sf):
    name = f"stackyard_days_{uuid.uuid4().hex[:8]}"
    ev = load(spark, sf, "events").withColumn("day", F.to_date("ts"))
    overwrite_days_table(ev, name, "day", path=scratch_path(spark, "io13t"))
    # the rerun of one day without its errors, columns in another order
    day = F.col("day") == F.lit("2024-01-05").cast("date")
    overwrite_days_table(ev.where(day & (F.col("event_type") != "error")).select("day", *ev.columns[:-1]), name, "day")
    return spark.table(name).groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n_events"),
                                                             F.round(F.sum("value"), 2).alias("total"))


@query("io14_federation", "IO14", sql="""
SELECT n_name, COUNT(*) AS n_customers, round(SUM(c_acctbal), 2) AS acctbal
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
""")
def io14_federation(spark, sf):
    csv_path = scratch_path(spark, "io14")
    TX.write_text(load(spark, sf, "nation"), csv_path, "gzip")
    tag = uuid.uuid4().hex[:8]
    register_sources(spark, {
        f"fed_customer_{tag}": {"format": "parquet", "path": f"{sf}/customer.parquet"},
        f"fed_nation_{tag}": {"format": "csv", "path": csv_path,
                              "schema": "n_nationkey int, n_name string, n_regionkey int"},
    })
    return spark.sql(f"""
        SELECT n_name, COUNT(*) AS n_customers, round(SUM(c_acctbal), 2) AS acctbal
        FROM fed_customer_{tag} JOIN fed_nation_{tag} ON c_nationkey = n_nationkey
        GROUP BY n_name""")


@query("c3_run_script", "C1,C2,C3", sql="""
SELECT o_orderstatus, COUNT(*) AS n_orders FROM orders GROUP BY o_orderstatus
""")
def c3_run_script(spark, sf):
    tag = uuid.uuid4().hex[:8]
    db, loc = f"stackyard_{tag}", scratch_path(spark, "c3")
    load(spark, sf, "orders").createOrReplaceTempView(f"orders_src_{tag}")
    script = f"""
    -- a rerunnable setup script
    DROP DATABASE IF EXISTS {db} CASCADE;
    CREATE DATABASE IF NOT EXISTS {db} LOCATION '{loc}';
    CREATE TABLE {db}.order_status USING parquet AS
      SELECT o_orderstatus, COUNT(*) AS n_orders FROM orders_src_{tag} GROUP BY o_orderstatus;
    SELECT o_orderstatus, n_orders FROM {db}.order_status
    """
    return run_script(spark, script)
