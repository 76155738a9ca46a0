"""X rows: scalar string functions on part, customer, nation, pages, documents."""

from pyspark.sql import functions as F

from stackyard.functions import strings as S
from stackyard.plans.registry import query
from stackyard.tables import load
from stackyard.operators.joins import lookup
from stackyard.plans.ordered import CLIENT_PORT

EMAIL = r"[a-z0-9.]+@mail[0-9]+\.example\.com"


@query("x1_split_field", "X1", sql="""
SELECT page_id, split_part(url, '/', 3) AS host, split_part(url, '/', 9) AS part9 FROM pages
""")
def x1_split_field(spark, sf):
    return load(spark, sf, "pages").select(
        "page_id", S.split_field("url", "/", 3).alias("host"),
        S.split_field("url", "/", 9).alias("part9"))


@query("x2_text_before", "X2", sql="""
SELECT page_id, split_part(url, '.example', 1) AS before_domain,
       split_part(url, '.tar', 1) AS before_tar FROM pages
""")
def x2_text_before(spark, sf):
    # literal separators: '.tar' must not match 'xtar'
    return load(spark, sf, "pages").select(
        "page_id", S.before("url", ".example").alias("before_domain"),
        S.before("url", ".tar").alias("before_tar"))


@query("x3_last_ws_field", "X3", sql=r"""
SELECT doc_id, regexp_split_to_array(trim(text), '\s+')[-1] AS last_word FROM documents
""")
def x3_last_ws_field(spark, sf):
    return load(spark, sf, "documents").select("doc_id", S.last_ws_field("text").alias("last_word"))


@query("x4_nth_ws_field", "X4", sql=r"""
SELECT doc_id, regexp_split_to_array(trim(text), '\s+')[3] AS word3,
       regexp_split_to_array(trim(text), '\s+')[25000] AS word25000 FROM documents
""")
def x4_nth_ws_field(spark, sf):
    return load(spark, sf, "documents").select(
        "doc_id", S.nth_ws_field("text", 3).alias("word3"),
        S.nth_ws_field("text", 25000).alias("word25000"))


@query("x5_replace_first", "X5", sql="""
SELECT p_partkey, regexp_replace(p_name, 'o', '0') AS p_name_1, p_type FROM part
""")
def x5_replace_first(spark, sf):
    return load(spark, sf, "part").select(
        "p_partkey", S.replace_first("p_name", "o", "0").alias("p_name_1"), "p_type")


@query("x6_render_template", "X6", sql="""
SELECT c_custkey,
       replace(replace(replace('jdbc://{nation}/{name}?segment={segment}',
               '{name}', c_name), '{nation}', n_name), '{segment}', c_mktsegment) AS rendered
FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def x6_render_template(spark, sf):
    cust = lookup(load(spark, sf, "customer"), load(spark, sf, "nation"),
                  F.col("c_nationkey") == F.col("n_nationkey"))
    params = F.create_map(F.lit("{name}"), F.col("c_name"), F.lit("{nation}"), F.col("n_name"),
                          F.lit("{segment}"), F.col("c_mktsegment"))
    return cust.select("c_custkey", S.render(F.lit("jdbc://{nation}/{name}?segment={segment}"),
                                             params).alias("rendered"))


@query("x7_replace_keep_match", "X7", sql=f"""
SELECT doc_id, regexp_replace(text, '{EMAIL}', '<\\0>', 'g') AS text FROM documents
""")
def x7_replace_keep_match(spark, sf):
    return load(spark, sf, "documents").select(
        "doc_id", S.replace_keep_match("text", EMAIL, suffix=">", prefix="<").alias("text"))


@query("x8_from_offset", "X8", sql="""
SELECT c_custkey, substr(c_name, 10) AS c_tail FROM customer
""")
def x8_from_offset(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", S.from_offset("c_name", 10).alias("c_tail"))


@query("x9_length", "X9", sql="""
SELECT doc_id, length(text) AS len_chars, n_chars FROM documents
""")
def x9_length(spark, sf):
    return load(spark, sf, "documents").select(
        "doc_id", F.length("text").cast("long").alias("len_chars"), "n_chars")


@query("x10_concat_literals", "X10", sql="""
SELECT n_nationkey, n_name || ':' || CAST(n_nationkey AS VARCHAR) || ':2181' AS endpoint,
       printf('%s-%04d', n_name, n_nationkey) AS label FROM nation
""")
def x10_concat_literals(spark, sf):
    return load(spark, sf, "nation").select(
        "n_nationkey",
        F.concat("n_name", F.lit(":"), F.col("n_nationkey").cast("string"), F.lit(CLIENT_PORT))
        .alias("endpoint"),
        F.format_string("%s-%04d", "n_name", "n_nationkey").alias("label"))


@query("x11_increment", "X11", sql="""
SELECT l_orderkey, l_linenumber, l_linenumber + 1 AS next_line FROM lineitem
""")
def x11_increment(spark, sf):
    return load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_linenumber") + 1).alias("next_line"))


@query("x12_array_ops", "X12", sql="""
WITH a AS (SELECT p_partkey, string_split(p_name, ' ') AS arr FROM part)
SELECT p_partkey, arr[1] AS first_token, CAST(len(arr) AS INTEGER) AS n_tokens,
       array_to_string(list_transform(arr, lambda x, i: CASE WHEN i = 2 THEN upper(x) ELSE x END), ' ')
         AS set_second,
       list_transform(generate_series(0, len(arr) - 1), lambda x: CAST(x AS INTEGER)) AS idx
FROM a
""")
def x12_array_ops(spark, sf):
    arr = F.split("p_name", " ")
    return load(spark, sf, "part").select(
        "p_partkey", F.get(arr, 0).alias("first_token"), F.size(arr).alias("n_tokens"),
        F.array_join(F.transform(arr, lambda x, i: F.when(i == 1, F.upper(x)).otherwise(x)), " ")
        .alias("set_second"),
        F.sequence(F.lit(0), F.size(arr) - 1).alias("idx"))


@query("x13_collapse_ws", "X13", sql=r"""
SELECT doc_id, regexp_replace(trim(text), '\s+', ' ', 'g') AS text FROM documents
""")
def x13_collapse_ws(spark, sf):
    return load(spark, sf, "documents").select("doc_id", S.collapse_ws("text").alias("text"))
