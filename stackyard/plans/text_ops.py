"""F rows (filters, predicates) and O4-O7 (line edits) over the driver's tables."""

from pyspark.sql import functions as F

from stackyard.functions import lines as L
from stackyard.functions.strings import field, member_of
from stackyard.operators.filters import route, text_class
from stackyard.plans.registry import query
from stackyard.tables import load

LICENSE = "(?i)licen[cs]e"


@query("f1_prefix_filter", "F1", sql="""
SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'hot')
""")
def f1_prefix_filter(spark, sf):
    return load(spark, sf, "part").where(F.col("p_name").startswith("hot")) \
        .select("p_partkey", "p_name")


@query("f2_pattern_filter", "F2", sql=f"""
SELECT doc_id, n_chars FROM documents WHERE regexp_matches(text, '{LICENSE}')
""")
def f2_pattern_filter(spark, sf):
    return load(spark, sf, "documents").where(F.col("text").rlike(LICENSE)) \
        .select("doc_id", "n_chars")


@query("f3_include_exclude", "F3", sql=r"""
SELECT page_id, url FROM pages
WHERE regexp_matches(url, '^https://') AND NOT regexp_matches(url, '\.example\.net')
""")
def f3_include_exclude(spark, sf):
    url = F.col("url")
    return load(spark, sf, "pages").where(url.rlike("^https://") & ~url.rlike(r"\.example\.net")) \
        .select("page_id", "url")


@query("f4_flag_equality", "F4", sql="""
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'
""")
def f4_flag_equality(spark, sf):
    return load(spark, sf, "orders").where(F.col("o_orderstatus") == "F") \
        .select("o_orderkey", "o_custkey")


@query("f5_length_predicates", "F5", sql="""
SELECT CASE WHEN text IS NULL THEN 'null' WHEN length(text) = 0 THEN 'empty'
            WHEN length(text) < 500 THEN 'short' ELSE 'long' END AS text_class,
       COUNT(*) AS n_docs
FROM documents GROUP BY 1
""")
def f5_length_predicates(spark, sf):
    return load(spark, sf, "documents").groupBy(text_class("text", 500).alias("text_class")) \
        .agg(F.count(F.lit(1)).alias("n_docs"))


@query("f6_exact_match", "F6", sql="""
SELECT n_nationkey, n_name FROM nation WHERE n_name = 'NATION_1'
""")
def f6_exact_match(spark, sf):
    # 'NATION_1' must not pick up 'NATION_10'..'NATION_19'
    return load(spark, sf, "nation").where(F.col("n_name") == "NATION_1") \
        .select("n_nationkey", "n_name")


@query("f7_member_of_list", "F7", sql="""
SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'rod')
""")
def f7_member_of_list(spark, sf):
    return load(spark, sf, "part").where(member_of(F.lit("rod"), "p_name", " ")) \
        .select("p_partkey", "p_name")


@query("f8_conjunction", "F8", sql="""
SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag, l_linestatus
FROM lineitem
WHERE (l_returnflag = 'R' AND l_quantity >= 45) OR (l_linestatus = 'O' AND l_discount >= 0.1)
""")
def f8_conjunction(spark, sf):
    c = F.col
    return load(spark, sf, "lineitem").where(
        ((c("l_returnflag") == "R") & (c("l_quantity") >= 45))
        | ((c("l_linestatus") == "O") & (c("l_discount") >= 0.1))
    ).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag",
             "l_linestatus")


@query("f9_positional_projection", "F9", sql="""
SELECT c_custkey, CASE WHEN instr(c_name, '#') > 0 THEN split_part(c_name, '#', 2) END AS c_serial,
       CASE WHEN instr(c_name, '#') > 0 AND len(string_split(c_name, '#')) >= 3
            THEN split_part(c_name, '#', 3) END AS c_extra
FROM customer
""")
def f9_positional_projection(spark, sf):
    # field 3 is missing on every row: NULL, never the whole line
    return load(spark, sf, "customer").select(
        "c_custkey", field("c_name", 2, "#").alias("c_serial"),
        field("c_name", 3, "#").alias("c_extra"))


EVENT_ROUTES = {"click": "ui", "view": "ui", "purchase": "billing", "signup": "accounts"}


@query("f10_route_by_value", "F10", sql="""
SELECT CASE event_type WHEN 'click' THEN 'ui' WHEN 'view' THEN 'ui'
                       WHEN 'purchase' THEN 'billing' WHEN 'signup' THEN 'accounts'
                       ELSE 'quarantine' END AS route,
       event_type, COUNT(*) AS n_events
FROM events GROUP BY 1, 2
""")
def f10_route_by_value(spark, sf):
    known, unknown = route(load(spark, sf, "events"), "event_type", EVENT_ROUTES,
                           quarantine="quarantine")
    both = known.unionByName(unknown)
    return both.groupBy("route", "event_type").agg(F.count(F.lit(1)).alias("n_events"))


@query("f11_line_delete", "F11", sql=f"""
SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\\r?\\n'),
                               lambda l: NOT regexp_matches(l, '{LICENSE}')), chr(10)) AS text
FROM documents
""")
def f11_line_delete(spark, sf):
    return load(spark, sf, "documents").select(
        "doc_id", L.delete_lines_text("text", LICENSE).alias("text"))


@query("o4_line_positions", "O4", sql=f"""
WITH s AS (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS arr FROM documents),
     l AS (SELECT doc_id, unnest(generate_series(1, len(arr))) AS line_no, unnest(arr) AS line FROM s)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM l
WHERE regexp_matches(line, '{LICENSE}')
""")
def o4_line_positions(spark, sf):
    return L.find_lines(load(spark, sf, "documents"), "doc_id", "text", LICENSE)


@query("o5_insert_after", "O5", sql=f"""
SELECT doc_id, array_to_string(flatten(list_transform(regexp_split_to_array(text, '\\r?\\n'),
         lambda l: CASE WHEN regexp_matches(l, '{LICENSE}') THEN [l, 'Reviewed-license: yes']
                   ELSE [l] END)), chr(10)) AS text
FROM documents
""")
def o5_insert_after(spark, sf):
    return load(spark, sf, "documents").select(
        "doc_id", L.insert_after_text("text", LICENSE, "Reviewed-license: yes").alias("text"))


@query("o6_drop_after", "O6", sql=f"""
WITH s AS (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS arr FROM documents)
SELECT doc_id, array_to_string(list_filter(arr,
         lambda l, i: i = 1 OR NOT regexp_matches(arr[i - 1], '{LICENSE}')), chr(10)) AS text
FROM s
""")
def o6_drop_after(spark, sf):
    return load(spark, sf, "documents").select(
        "doc_id", L.drop_after_text("text", LICENSE).alias("text"))


@query("o7_comment_out", "O7", sql=f"""
SELECT doc_id, array_to_string(list_transform(regexp_split_to_array(text, '\\r?\\n'),
         lambda l: CASE WHEN regexp_matches(l, '{LICENSE}') THEN '#' || l ELSE l END), chr(10)) AS text
FROM documents
""")
def o7_comment_out(spark, sf):
    return load(spark, sf, "documents").select(
        "doc_id", L.comment_out_text("text", LICENSE).alias("text"))


@query("o4_lines_roundtrip", "O4", sql="""
SELECT doc_id, text FROM documents
""")
def o4_lines_roundtrip(spark, sf):
    # row form then rebuild: the ordered concat gives every text back
    docs = load(spark, sf, "documents")
    return L.unlines(L.lines(docs, "doc_id", "text"), "doc_id")
