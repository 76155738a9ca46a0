"""S rows: the thin SQL surface, written as a Spark user writes it
(DataFrame API or ``spark.sql`` with DataFrame parameters, no global views).
Per-key windows use the skew-safe operators of ``operators.ordinal``."""

import datetime as dt

from pyspark.sql import functions as F

from stackyard.operators import ordinal as O
from stackyard.operators import sketches as SK
from stackyard.operators.asof import asof_join
from stackyard.operators.ranges import range_frame, range_join, range_totals
from stackyard.plans.registry import query
from stackyard.session import scratch_path
from stackyard.streaming.events import interval_join
from stackyard.tables import load


@query("s1_scan_filter", "S1", sql="""
SELECT p_partkey, p_name, p_brand, p_size FROM part
WHERE p_size BETWEEN 10 AND 20 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')
  AND p_name LIKE '%rod%'
""")
def s1_scan_filter(spark, sf):
    p = load(spark, sf, "part")
    return p.where(F.col("p_size").between(10, 20) & F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3")
                   & F.col("p_name").like("%rod%")).select("p_partkey", "p_name", "p_brand", "p_size")


@query("s2_multiway_join", "S2", sql="""
SELECT r_name, n_name, round(SUM(l_extendedprice * (1 - l_discount)), 4) AS revenue,
       COUNT(*) AS n_lines
FROM customer JOIN orders ON c_custkey = o_custkey
     JOIN lineitem ON l_orderkey = o_orderkey
     JOIN nation ON c_nationkey = n_nationkey
     JOIN region ON n_regionkey = r_regionkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'
GROUP BY r_name, n_name
""")
def s2_multiway_join(spark, sf):
    return spark.sql("""
        SELECT r_name, n_name, round(SUM(l_extendedprice * (1 - l_discount)), 4) AS revenue,
               COUNT(*) AS n_lines
        FROM {customer} c JOIN {orders} o ON c_custkey = o_custkey
             JOIN {lineitem} l ON l_orderkey = o_orderkey
             JOIN {nation} n ON c_nationkey = n_nationkey
             JOIN {region} r ON n_regionkey = r_regionkey
        WHERE o_orderdate >= TIMESTAMP_NTZ'1996-01-01 00:00:00'
          AND o_orderdate < TIMESTAMP_NTZ'1998-01-01 00:00:00'
        GROUP BY r_name, n_name""",
        **{t: load(spark, sf, t) for t in ("customer", "orders", "lineitem", "nation", "region")})


@query("s3_outer_joins", "S3", sql="""
SELECT 'left' AS kind, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE o_orderkey IS NULL) AS n_unmatched
FROM customer LEFT JOIN orders ON c_custkey = o_custkey
UNION ALL
SELECT 'right' AS kind, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE c_custkey IS NULL) AS n_unmatched
FROM customer RIGHT JOIN orders ON c_custkey = o_custkey
UNION ALL
SELECT 'full' AS kind, COUNT(*) AS n_rows,
       COUNT(*) FILTER (WHERE c_custkey IS NULL OR o_orderkey IS NULL) AS n_unmatched
FROM customer FULL JOIN orders ON c_custkey = o_custkey
""")
def s3_outer_joins(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey")
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    on = c.c_custkey == o.o_custkey
    parts = []
    for kind, miss in (("left", o.o_orderkey.isNull()), ("right", c.c_custkey.isNull()),
                       ("full", c.c_custkey.isNull() | o.o_orderkey.isNull())):
        j = c.join(o, on, kind)
        parts.append(j.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n_rows"),
                           F.count(F.when(miss, 1)).alias("n_unmatched")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s4_range_join", "S4", sql="""
SELECT c_custkey, COUNT(*) AS n_suppliers
FROM customer JOIN supplier ON c_nationkey = s_nationkey
 AND s_acctbal BETWEEN c_acctbal - 100 AND c_acctbal + 100
GROUP BY c_custkey
""")
def s4_range_join(spark, sf):
    # a band count needs no pairs: a running count at the upper bound less the one at the lower bound
    c = load(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"),
                                           (F.col("c_acctbal") - 100.0).alias("lo"), (F.col("c_acctbal") + 100.0).alias("hi"))
    s = load(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("at"))
    n = range_totals(c, s, "nation", "lo", "hi", "at", count="n_suppliers")
    return n.where("n_suppliers > 0").select("c_custkey", "n_suppliers")


@query("s4_interval_rows", "S4", sql="""
SELECT c_custkey, o_orderkey, o_totalprice
FROM customer JOIN orders ON c_nationkey = o_custkey % 25
 AND o_totalprice BETWEEN 20 * abs(c_acctbal) AND 20 * abs(c_acctbal) + 10 * (1 + c_custkey % 97)
""")
def s4_interval_rows(spark, sf):
    # every customer has an interval of its own width: 10 to 970
    lo = 20 * F.abs("c_acctbal")
    c = load(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("nation"), lo.alias("lo"),
                                           (lo + 10 * (1 + F.col("c_custkey") % 97)).alias("hi"))
    o = load(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("nation"), "o_totalprice")
    return range_join(c, o, ["nation"], "lo", "hi", "o_totalprice", unit=50.0).select(
        "c_custkey", "o_orderkey", "o_totalprice")


@query("s5_asof_join", "S5", sql="""
SELECT p.event_id AS purchase_id, p.user_id, v.event_id AS view_id, v.ts AS view_ts
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v
  ON p.user_id = v.user_id AND p.ts >= v.ts
""")
def s5_asof_join(spark, sf):
    ev = load(spark, sf, "events")
    buys = ev.where(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("purchase_id"), "user_id", "ts")
    views = ev.where(F.col("event_type") == "view").select(
        "user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"))
    j = asof_join(buys, views, "user_id", "ts", "view_ts", ["view_id", "view_ts"],
                  right_tiebreak="view_id")
    return j.select("purchase_id", "user_id", "view_id", "view_ts")


@query("s6_group_having", "S6", sql="""
SELECT l_returnflag, l_linestatus, round(SUM(l_quantity), 2) AS sum_qty,
       round(SUM(l_extendedprice), 2) AS sum_base_price,
       round(SUM(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price,
       round(AVG(l_quantity), 6) AS avg_qty, MIN(l_discount) AS min_disc, MAX(l_tax) AS max_tax,
       COUNT(*) AS count_order
FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING 6 * COUNT(*) > (SELECT COUNT(*) FROM lineitem)
""")
def s6_group_having(spark, sf):
    li = load(spark, sf, "lineitem")
    g = li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("sum_disc_price"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
        F.min("l_discount").alias("min_disc"), F.max("l_tax").alias("max_tax"),
        F.count(F.lit(1)).alias("count_order"))
    # groups above a sixth of the table
    total = li.agg(F.count(F.lit(1)).alias("n"))
    return g.where(6 * F.col("count_order") > total.scalar())


@query("s7_count_distinct", "S7", sql="""
SELECT event_type, COUNT(DISTINCT user_id) AS n_users, COUNT(*) AS n_events
FROM events GROUP BY event_type
""")
def s7_count_distinct(spark, sf):
    return load(spark, sf, "events").groupBy("event_type").agg(
        F.count_distinct("user_id").alias("n_users"), F.count(F.lit(1)).alias("n_events"))


@query("s8_approx_count_distinct", "S8", sql="""
SELECT event_type, COUNT(DISTINCT user_id) AS n_users, true AS sketch_within_a_tenth
FROM events GROUP BY event_type
""")
def s8_approx_count_distinct(spark, sf):
    # HyperLogLog++ sketches merge map-side; five standard deviations of 0.02.  The exact count is an
    # aggregate of its own: beside a distinct count, Spark keeps a sketch per type and user
    ev = load(spark, sf, "events")
    sketch = ev.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("sketch"))
    exact = ev.groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"))
    g = O.null_safe_join(exact, sketch, ["event_type"])
    return g.select("event_type", "n_users",
                    (F.abs(F.col("sketch") - F.col("n_users")) <= 0.1 * F.col("n_users"))
                    .alias("sketch_within_a_tenth"))


@query("s8_sketch_ranges", "S8", sql="""
WITH r(lo, hi) AS (VALUES (DATE '2024-01-01', DATE '2024-01-07'), (DATE '2024-01-05', DATE '2024-01-20'),
                          (DATE '2024-01-01', DATE '2024-01-31'))
SELECT lo, hi, event_type, COUNT(DISTINCT user_id) AS n_users, COUNT(*) AS n_events,
       true AS users_within_a_tenth, true AS median_within_a_tenth_of_ranks
FROM events JOIN r ON CAST(ts AS DATE) BETWEEN lo AND hi GROUP BY lo, hi, event_type
""")
def s8_sketch_ranges(spark, sf):
    # sketches per day are written once; any range of days is answered from them
    ev = load(spark, sf, "events").withColumn("day", F.to_date("ts"))
    daily = scratch_path(spark, "s8-daily")
    SK.daily_sketches(ev, "day", ["event_type"], "user_id", "value").write.parquet(daily)
    ranges = spark.createDataFrame([(dt.date(2024, 1, a), dt.date(2024, 1, b)) for a, b in ((1, 7), (5, 20), (1, 31))],
                                   "lo date, hi date")
    got = SK.sketch_ranges(spark.read.parquet(daily), ranges, "day", ["event_type"], [0.5])
    # the exact answers, for comparison only
    days = F.col("day").between(F.col("lo"), F.col("hi"))
    exact = ev.join(F.broadcast(ranges.withColumn("day", F.explode(F.sequence("lo", "hi")))), "day").where(days)
    both = exact.join(got.select("lo", "hi", "event_type", "n_distinct", F.col("quantiles")[0].alias("median")),
                      ["lo", "hi", "event_type"]).groupBy("lo", "hi", "event_type").agg(
        F.count_distinct("user_id").alias("n_users"), F.count(F.lit(1)).alias("n_events"),
        F.max("n_distinct").alias("sketch"), F.avg((F.col("value") < F.col("median")).cast("int")).alias("below"),
        F.avg((F.col("value") <= F.col("median")).cast("int")).alias("upto"))
    return both.select("lo", "hi", "event_type", "n_users", "n_events",
                       (F.abs(F.col("sketch") - F.col("n_users")) <= 0.1 * F.col("n_users")).alias("users_within_a_tenth"),
                       ((F.col("below") <= 0.6) & (F.col("upto") >= 0.4)).alias("median_within_a_tenth_of_ranks"))


@query("s9_grouping_sets", "S9", sql="""
SELECT o_orderstatus, o_orderpriority, CAST(GROUPING(o_orderstatus, o_orderpriority) AS BIGINT) AS gid,
       COUNT(*) AS n_orders, round(SUM(o_totalprice), 2) AS total
FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())
""")
def s9_grouping_sets(spark, sf):
    o = load(spark, sf, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return o.groupingSets([[status, priority], [priority], []], status, priority).agg(
        F.grouping_id().cast("long").alias("gid"), F.count(F.lit(1)).alias("n_orders"),
        F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("s9_cube", "S9", sql="""
SELECT o_orderstatus, o_orderpriority, CAST(GROUPING(o_orderstatus, o_orderpriority) AS BIGINT) AS gid,
       COUNT(*) AS n_orders, round(SUM(o_totalprice), 2) AS total
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
""")
def s9_cube(spark, sf):
    o = load(spark, sf, "orders")
    return o.cube("o_orderstatus", "o_orderpriority").agg(
        F.grouping_id().cast("long").alias("gid"), F.count(F.lit(1)).alias("n_orders"),
        F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("s9_rollup", "S9", sql="""
SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n_orders
FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)
""")
def s9_rollup(spark, sf):
    return load(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority") \
        .agg(F.count(F.lit(1)).alias("n_orders"))


@query("s10_ranking", "S10", sql="""
SELECT o_custkey, o_orderkey, o_totalprice,
       row_number() OVER w AS row_number, rank() OVER v AS rank,
       dense_rank() OVER v AS dense_rank, ntile(4) OVER w AS ntile
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey),
                   v AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC)
""")
def s10_ranking(spark, sf):
    o = load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return O.ranks(o, ["o_custkey"], "o_totalprice", "o_orderkey", descending=True, tiles=4)


@query("s11_lag_lead", "S11", sql="""
SELECT event_id, user_id,
       lag(event_type) OVER w AS lag_event_type, lag(ts) OVER w AS lag_ts,
       lead(event_type) OVER w AS lead_event_type,
       first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_type,
       last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_type
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def s11_lag_lead(spark, sf):
    ev = load(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return O.over(ev, ["user_id"], ["ts", "event_id"], {
        "lag_event_type": O.lag("event_type"), "lag_ts": O.lag("ts"), "lead_event_type": O.lead("event_type"),
        "first_type": O.first("event_type"), "last_type": O.last("event_type")}).drop("ts", "event_type")


@query("s12_frames", "S12", sql="""
SELECT o_orderkey, o_custkey,
       round(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running_total,
       round(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate
                                     RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW), 2)
         AS total_30d
FROM orders
""")
def s12_frames(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    run = O.running_sum(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice",
                        out="running_total")
    both = range_frame(run, ["o_custkey"], "o_orderdate", "30 days", {"total_30d": ("sum", "o_totalprice")})
    return both.select("o_orderkey", "o_custkey", F.round("running_total", 2).alias("running_total"),
                       F.round("total_30d", 2).alias("total_30d"))


@query("s12_sliding", "S12", sql="""
SELECT o_orderkey, o_custkey, MIN(o_totalprice) OVER r AS min_7, MAX(o_totalprice) OVER r AS max_7, COUNT(*) OVER r AS n_7,
       MIN(o_totalprice) OVER d AS min_30d, MAX(o_totalprice) OVER d AS max_30d, COUNT(*) OVER d AS n_30d
FROM orders WINDOW r AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS 6 PRECEDING),
  d AS (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)
""")
def s12_sliding(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    rows = O.over(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], {
        "min_7": O.rows_frame(F.min, "o_totalprice", 6), "max_7": O.rows_frame(F.max, "o_totalprice", 6),
        "n_7": O.rows_frame(F.count, "o_orderkey", 6)})
    return range_frame(rows, ["o_custkey"], "o_orderdate", "30 days", {
        "min_30d": ("min", "o_totalprice"), "max_30d": ("max", "o_totalprice"), "n_30d": ("count", None)}).drop(
        "o_orderdate", "o_totalprice")


@query("s13_top_k", "S13", sql="""
SELECT 'per_customer' AS scope, o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn
  FROM orders) WHERE rn <= 3
UNION ALL
SELECT * FROM (SELECT 'global' AS scope, o_custkey, o_orderkey, o_totalprice FROM orders
               ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)
""")
def s13_top_k(spark, sf):
    o = load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    per = O.top_n(o, ["o_custkey"], [O.desc("o_totalprice"), "o_orderkey"], 3) \
        .withColumn("scope", F.lit("per_customer"))
    top = o.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10) \
        .withColumn("scope", F.lit("global"))
    return per.unionByName(top).select("scope", "o_custkey", "o_orderkey", "o_totalprice")


@query("s14_set_ops", "S14", sql="""
WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'),
     b AS (SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b)
UNION ALL SELECT 'intersect' AS op, k FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
UNION ALL SELECT 'except' AS op, k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
UNION ALL SELECT 'except_all' AS op, k FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b)
""")
def s14_set_ops(spark, sf):
    o = load(spark, sf, "orders")
    a = o.where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("k"))
    b = o.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("k"))
    return (a.union(b).distinct().withColumn("op", F.lit("union"))
            .unionByName(a.intersect(b).withColumn("op", F.lit("intersect")))
            .unionByName(a.subtract(b).withColumn("op", F.lit("except")))
            .unionByName(a.exceptAll(b).withColumn("op", F.lit("except_all")))
            .select("op", "k"))


@query("s15_subqueries", "S15", sql="""
WITH big AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders o1
             WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders o2 WHERE o2.o_custkey = o1.o_custkey))
SELECT o_orderkey, o_custkey FROM big
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)
""")
def s15_subqueries(spark, sf):
    return spark.sql("""
        WITH big AS (SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} o1
                     WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM {orders} o2
                                           WHERE o2.o_custkey = o1.o_custkey))
        SELECT o_orderkey, o_custkey FROM big
        WHERE EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_quantity > 45)""",
        orders=load(spark, sf, "orders"), lineitem=load(spark, sf, "lineitem"))


@query("s16_string_functions", "S16", sql="""
SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, length(p_name) AS len,
       substr(p_name, 2, 4) AS sub, concat(p_brand, '/', p_type) AS cat,
       replace(p_name, ' ', '_') AS repl, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded,
       instr(p_name, 'o') AS pos_o, reverse(p_name) AS rev, trim('  ' || p_name || '  ') AS trimmed,
       starts_with(p_name, 'new') AS is_new
FROM part
""")
def s16_string_functions(spark, sf):
    p = load(spark, sf, "part")
    return p.select(
        "p_partkey", F.upper("p_name").alias("up"), F.lower("p_brand").alias("low"),
        F.length("p_name").cast("long").alias("len"), F.substring("p_name", 2, 4).alias("sub"),
        F.concat("p_brand", F.lit("/"), "p_type").alias("cat"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("repl"),
        F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"),
        F.instr("p_name", "o").cast("long").alias("pos_o"), F.reverse("p_name").alias("rev"),
        F.trim(F.concat(F.lit("  "), "p_name", F.lit("  "))).alias("trimmed"),
        F.col("p_name").startswith("new").alias("is_new"))


@query("s17_date_functions", "S17", sql="""
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(month(o_orderdate) AS INTEGER) AS mon,
       CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS dow, CAST(o_orderdate AS DATE) + 30 AS due,
       CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS INTEGER) AS days_to_2000,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
       last_day(CAST(o_orderdate AS DATE)) AS month_end, strftime(o_orderdate, '%Y-%m') AS ym
FROM orders
""")
def s17_date_functions(spark, sf):
    o = load(spark, sf, "orders")
    d = F.to_date("o_orderdate")
    return o.select(
        "o_orderkey", F.year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("mon"),
        F.dayofweek("o_orderdate").alias("dow"), F.date_add(d, 30).alias("due"),
        F.datediff(F.lit("2000-01-01").cast("date"), d).alias("days_to_2000"),
        F.trunc(d, "month").alias("month_start"), F.last_day(d).alias("month_end"),
        F.date_format("o_orderdate", "yyyy-MM").alias("ym"))


@query("s18_math_functions", "S18", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, abs(l_quantity - 25) AS dist,
       CAST(ceil(l_extendedprice / 1000) AS BIGINT) AS k_ceil,
       CAST(floor(l_extendedprice / 1000) AS BIGINT) AS k_floor,
       round(sqrt(l_extendedprice), 6) AS root, round(pow(l_discount, 2), 6) AS disc_sq,
       round(log10(l_extendedprice + 1), 6) AS lg, CAST(l_partkey % 7 AS BIGINT) AS m7,
       round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge,
       CAST(sign(l_quantity - 25) AS DOUBLE) AS sgn
FROM lineitem
""")
def s18_math_functions(spark, sf):
    li = load(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.abs(F.col("l_quantity") - 25).alias("dist"),
        F.ceil(F.col("l_extendedprice") / 1000).cast("long").alias("k_ceil"),
        F.floor(F.col("l_extendedprice") / 1000).cast("long").alias("k_floor"),
        F.round(F.sqrt("l_extendedprice"), 6).alias("root"),
        F.round(F.pow("l_discount", 2), 6).alias("disc_sq"),
        F.round(F.log10(F.col("l_extendedprice") + 1), 6).alias("lg"),
        F.pmod("l_partkey", F.lit(7)).cast("long").alias("m7"),
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")), 6)
        .alias("charge"),
        F.signum(F.col("l_quantity") - 25).alias("sgn"))


@query("s19_array_functions", "S19", sql="""
SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dim,
       round(list_reduce(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), lambda a, b: a + b), 6) AS total,
       round(sqrt(list_reduce(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)),
                              lambda a, b: a + b)), 6) AS norm,
       CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS n_pos,
       round(CAST(list_max(embedding) AS DOUBLE), 6) AS top
FROM embeddings
""")
def s19_array_functions(spark, sf):
    e = load(spark, sf, "embeddings")
    dbl = F.transform("embedding", lambda x: x.cast("double"))
    return e.select(
        "vec_id", "label", F.size("embedding").alias("dim"),
        F.round(F.aggregate(dbl, F.lit(0.0), lambda a, b: a + b), 6).alias("total"),
        F.round(F.sqrt(F.aggregate(F.transform(dbl, lambda x: x * x), F.lit(0.0),
                                   lambda a, b: a + b)), 6).alias("norm"),
        F.size(F.filter("embedding", lambda x: x > 0)).alias("n_pos"),
        F.round(F.array_max("embedding").cast("double"), 6).alias("top"))


@query("s20_json_extraction", "S20", sql="""
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k_path,
       CAST(json_extract(props, '$.k') AS INTEGER) AS k_struct,
       json_extract_string(props, '$.missing') AS missing
FROM events
""")
def s20_json_extraction(spark, sf):
    ev = load(spark, sf, "events")
    return ev.select("event_id",
                     F.get_json_object("props", "$.k").cast("int").alias("k_path"),
                     F.from_json("props", "k int").getField("k").alias("k_struct"),
                     F.get_json_object("props", "$.missing").alias("missing"))


@query("s21_map_lookup", "S21", sql="""
WITH c AS (SELECT user_id, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2),
     m AS (SELECT user_id, map_from_entries(list({'k': event_type, 'v': n})) AS counts FROM c GROUP BY 1)
SELECT user_id, counts['click'] AS n_click, CAST(cardinality(counts) AS INTEGER) AS n_types FROM m
""")
def s21_map_lookup(spark, sf):
    ev = load(spark, sf, "events")
    c = ev.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    # one map per user: bounded by the number of event types, not by rows
    m = c.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("counts"))
    return m.select("user_id", F.try_element_at("counts", F.lit("click")).alias("n_click"),
                    F.size("counts").alias("n_types"))


@query("s22_lateral_view", "S22", sql="""
SELECT token, COUNT(*) AS n_parts FROM (SELECT unnest(string_split(p_name, ' ')) AS token FROM part)
GROUP BY token
""")
def s22_lateral_view(spark, sf):
    return spark.sql("""
        SELECT token, COUNT(*) AS n_parts
        FROM {part} LATERAL VIEW explode(split(p_name, ' ')) t AS token
        GROUP BY token""", part=load(spark, sf, "part"))


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("s23_pivot", "S23", sql="""
SELECT user_id, COUNT(*) FILTER (WHERE event_type = 'click') AS click,
       COUNT(*) FILTER (WHERE event_type = 'error') AS error,
       COUNT(*) FILTER (WHERE event_type = 'purchase') AS purchase,
       COUNT(*) FILTER (WHERE event_type = 'signup') AS signup,
       COUNT(*) FILTER (WHERE event_type = 'view') AS "view"
FROM events GROUP BY user_id
""")
def s23_pivot(spark, sf):
    # explicit values: no extra job to discover them
    p = load(spark, sf, "events").groupBy("user_id").pivot("event_type", EVENT_TYPES) \
        .agg(F.count(F.lit(1)))
    return p.select("user_id", *[F.coalesce(F.col(t), F.lit(0)).alias(t) for t in EVENT_TYPES])
