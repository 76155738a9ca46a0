"""J rows: placement gaps, anti, semi, lookup, membership and dependency joins."""

from pyspark.sql import functions as F

from stackyard.operators import joins as J
from stackyard.plans.registry import query
from stackyard.tables import load


def _supplied_types(spark, sf):
    """(nation, part type) pairs some supplier of the nation has shipped."""
    li = load(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    sup = load(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("host"))
    part = load(spark, sf, "part").select("p_partkey", F.col("p_type").alias("package"))
    return (li.join(sup, li.l_suppkey == sup.s_suppkey)
            .join(part, li.l_partkey == part.p_partkey)
            .select("host", "package"))


@query("j1_placement_gaps", "J1", sql="""
WITH present AS (SELECT DISTINCT s_nationkey AS host, p_type AS package
                 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
                               JOIN part ON l_partkey = p_partkey),
     have AS (SELECT host, COUNT(*) AS n_present FROM present GROUP BY host)
SELECT n_nationkey AS host, COALESCE(n_present, 0) AS n_present,
       (SELECT COUNT(DISTINCT p_type) FROM part) - COALESCE(n_present, 0) AS n_missing
FROM nation LEFT JOIN have ON n_nationkey = host
""")
def j1_placement_gaps(spark, sf):
    hosts = load(spark, sf, "nation").select(F.col("n_nationkey").alias("host"))
    catalog = load(spark, sf, "part").select(F.col("p_type").alias("package"))
    return J.placement_gaps(hosts, _supplied_types(spark, sf), catalog)


@query("j2_anti_join", "J2", sql="""
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
""")
def j2_anti_join(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    li = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.anti(o, li, ["o_orderkey"])


@query("j3_semi_join", "J3", sql="""
SELECT o_orderkey, o_orderstatus FROM orders
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
""")
def j3_semi_join(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    li = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.semi(o, li, ["o_orderkey"])


@query("j4_lookup", "J4", sql="""
SELECT c_custkey, n_name, r_name
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
              LEFT JOIN region ON n_regionkey = r_regionkey
""")
def j4_lookup(spark, sf):
    cust = load(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nat = load(spark, sf, "nation")
    reg = load(spark, sf, "region")
    out = J.lookup(cust, nat, cust.c_nationkey == nat.n_nationkey, "left")
    out = J.lookup(out, reg, out.n_regionkey == reg.r_regionkey, "left")
    return out.select("c_custkey", "n_name", "r_name")


@query("j5_member_join", "J5", sql="""
WITH vocab AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token
               FROM part WHERE p_brand = 'Brand#1'),
     toks AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS member FROM part)
SELECT p_partkey, member FROM toks JOIN vocab ON member = token
""")
def j5_member_join(spark, sf):
    part = load(spark, sf, "part")
    vocab = (part.where(F.col("p_brand") == "Brand#1")
             .select(F.explode(F.split("p_name", " ")).alias("token")).distinct())
    return J.member_join(part.select("p_partkey", "p_name"), "p_name", vocab, "token",
                         sep=" ").select("p_partkey", "member")


# The declared dependency between part types (which type needs
# which other type for the same customer), in the spirit of "Kafka needs
# ZooKeeper".  The items placed on each customer come from the data.
TYPE_DEPENDENCIES = [
    ("ECONOMY", "STANDARD"),
    ("PROMO", "STANDARD"),
    ("LARGE", "MEDIUM"),
    ("MEDIUM", "SMALL"),
    ("SMALL", "ECONOMY"),
]


@query("j6_missing_dependencies", "J6", sql="""
WITH items AS (SELECT DISTINCT o_custkey AS node, p_type AS item
               FROM lineitem JOIN orders ON l_orderkey = o_orderkey
                             JOIN part ON l_partkey = p_partkey),
     edges AS (SELECT * FROM (VALUES ('ECONOMY', 'STANDARD'), ('PROMO', 'STANDARD'),
                     ('LARGE', 'MEDIUM'), ('MEDIUM', 'SMALL'), ('SMALL', 'ECONOMY')) e(item, requires))
SELECT i.item, i.node, e.requires FROM items i JOIN edges e ON i.item = e.item
WHERE NOT EXISTS (SELECT 1 FROM items h WHERE h.node = i.node AND h.item = e.requires)
""")
def j6_missing_dependencies(spark, sf):
    # node = customer, item = part type the customer bought
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    o = load(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("node"))
    p = load(spark, sf, "part").select("p_partkey", F.col("p_type").alias("item"))
    items = (li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
             .select("node", "item"))
    edges = spark.createDataFrame(TYPE_DEPENDENCIES, "item string, requires string")
    return J.missing_dependencies(items, edges)
