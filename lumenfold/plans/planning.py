"""Semantic types, coverage of files, merge plans and requirement lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions.semantics import STANDARD_LIKE, entity_kind, semantic_type
from lumenfold.functions.text import norm_header
from lumenfold.operators import planning, profile
from lumenfold.plans.registry import load, query

_SUFFIXES = ["Id", "Date", "Count", "Hash", "URL", "Fee", "Phone", "Status", "Title", "QCO ref", "Validity", "Notes"]


@query("""SELECT replace(lower(n_name), '#', '_') || '_' || replace(lower(s), ' ', '_') AS header,
 CASE s WHEN 'Id' THEN 'PRIMARY_KEY_ID' WHEN 'Date' THEN 'DATE' WHEN 'Count' THEN 'NUMERIC_OR_COUNT' WHEN 'Hash' THEN 'CONTENT_HASH' WHEN 'URL' THEN 'URL' WHEN 'Fee' THEN 'FEE' WHEN 'Phone' THEN 'CONTACT' WHEN 'Status' THEN 'STATUS' WHEN 'Title' THEN 'TITLE' WHEN 'QCO ref' THEN 'QCO_REFERENCE' WHEN 'Validity' THEN 'DATE' ELSE 'UNCLASSIFIED_STRING' END AS semantic_type
FROM nation, (SELECT unnest(['Id', 'Date', 'Count', 'Hash', 'URL', 'Fee', 'Phone', 'Status', 'Title', 'QCO ref', 'Validity', 'Notes']) AS s)""")
def semantic_headers(spark, sf_dir):
    names = load(spark, sf_dir, "nation").select("n_name", F.explode(F.array(*map(F.lit, _SUFFIXES))).alias("s"))
    zero = F.lit(0)
    rows = names.select(norm_header(F.concat_ws(" ", "n_name", "s")).alias("header"))
    return rows.select("header", semantic_type(F.col("header"), F.lit("string"), zero, zero, F.lit(0.0), F.lit(0.0)).alias("semantic_type"))


@query("""SELECT replace(lower(n_name), '#', '_') || '_' || s AS header, CASE s WHEN 'qco_no' THEN 'QCO' WHEN 'lab_name' THEN 'LAB' WHEN 'is_number' THEN 'IS' WHEN 'product_title' THEN 'PRODUCT' WHEN 'scheme_id' THEN 'SCHEME' WHEN 'gazette_no' THEN 'DOC' ELSE '' END AS kind
FROM nation, (SELECT unnest(['qco_no', 'lab_name', 'is_number', 'product_title', 'scheme_id', 'gazette_no', 'scheme_record_id', 'product_note', 'colour']) AS s)""")
def entity_kinds(spark, sf_dir):
    suffixes = ["qco_no", "lab_name", "is_number", "product_title", "scheme_id", "gazette_no", "scheme_record_id", "product_note", "colour"]
    names = load(spark, sf_dir, "nation").select("n_name", F.explode(F.array(*map(F.lit, suffixes))).alias("s")).select(norm_header(F.concat_ws(" ", "n_name", "s")).alias("header"))
    return names.select("header", entity_kind(F.col("header")).alias("kind"))


@query("""WITH f AS (SELECT 'doc_id' AS col, avg(length(CAST(doc_id AS VARCHAR))) AS l, bool_and(regexp_matches(CAST(doc_id AS VARCHAR), '^[0-9]+$')) AS num FROM documents UNION ALL SELECT 'text', avg(length(text)), bool_and(regexp_matches(text, '^[0-9]+$')) FROM documents
 UNION ALL SELECT 'lang', avg(length(lang)), false FROM documents UNION ALL SELECT 'source', avg(length(source)), false FROM documents UNION ALL SELECT 'n_chars', avg(length(CAST(n_chars AS VARCHAR))), bool_and(regexp_matches(CAST(n_chars AS VARCHAR), '^[0-9]+$')) FROM documents)
SELECT col AS "column", CASE WHEN col LIKE '%\\_id' ESCAPE '\\' THEN 'PRIMARY_KEY_ID' WHEN num THEN 'NUMERIC_OR_COUNT' WHEN l > 80 THEN 'FREE_TEXT' ELSE 'UNCLASSIFIED_STRING' END AS semantic_type FROM f""")
def semantic_columns(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    facts = profile.cells(docs).groupBy("column").agg(F.count("value").alias("n"), F.sum(F.col("value").rlike(STANDARD_LIKE).cast("long")).alias("hits"), F.avg(F.length("value")).alias("length"))
    typed = facts.join(profile.profile_columns(docs).select("column", "data_type", "multivalue_ratio"), "column")
    return typed.select("column", semantic_type(norm_header(F.col("column")), F.col("data_type"), F.col("n"), F.col("hits"), F.col("multivalue_ratio"), F.col("length")).alias("semantic_type"))


_KEYED = "SELECT DISTINCT 'F' || CAST(l_linenumber AS VARCHAR) AS file_id, l_suppkey AS key FROM lineitem"


@query(f"""WITH k AS ({_KEYED}), n AS (SELECT key, count(*) AS n FROM k GROUP BY key), o AS (SELECT file_id, count(*) AS n_keys, count(*) FILTER (n = 1) AS unique_keys FROM k JOIN n USING (key) GROUP BY 1),
m AS (SELECT a.file_id, b.file_id AS other, count(*) AS shared FROM k a JOIN k b ON a.key = b.key AND a.file_id <> b.file_id GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY shared DESC, other) AS nth FROM m)
SELECT o.file_id, n_keys, unique_keys, other AS best_cover, round(coalesce(shared / n_keys, 0), 4) AS covered, coalesce(shared, 0) = n_keys AS residual_free FROM o LEFT JOIN r ON r.file_id = o.file_id AND nth = 1""")
def file_coverage(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem")
    return planning.coverage(line.select(F.concat(F.lit("F"), F.col("l_linenumber").cast("string")).alias("file_id"), F.col("l_suppkey").alias("key")))


@query("""WITH m AS (SELECT n_regionkey AS cluster, n_name AS file_id, n_nationkey * 10 AS n_rows, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey * 9 END AS n_keys FROM nation)
SELECT cluster, count(*) AS n_files, sum(n_rows)::BIGINT AS rows_in, max(n_keys)::BIGINT AS least_out, sum(coalesce(n_keys, n_rows))::BIGINT AS most_out, arg_max(file_id, n_rows) AS canonical, 'k' AS key_column FROM m GROUP BY cluster""")
def merge_plan(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("long")
    members = n.select(F.col("n_regionkey").alias("cluster"), F.col("n_name").alias("file_id"), (key * 10).alias("n_rows"), F.when(key % 3 != 0, key * 9).alias("n_keys"), F.lit("k").alias("key_column"))
    return planning.merge_plan(members)


@query("""WITH a AS (SELECT 'Handle ' || r_name AS requirement, 'manual' AS evidence_expected, 'region' AS source, 'MANUAL' AS type, 0 AS p, r_regionkey AS o FROM region ORDER BY o LIMIT 3), b AS (SELECT 'Test ' || n_name, 'test report', 'nation', 'TESTING', 1, n_nationkey FROM nation ORDER BY n_nationkey LIMIT 15),
u AS (SELECT *, row_number() OVER (ORDER BY p, o, requirement) AS nth FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) SELECT 'REQ-' || lpad(CAST(nth AS VARCHAR), 3, '0') AS requirement_id, requirement, type, source, evidence_expected FROM u WHERE nth <= 12""")
def requirement_list(spark, sf_dir):
    r = load(spark, sf_dir, "region").select(F.concat(F.lit("Handle "), "r_name").alias("requirement"), F.lit("manual").alias("evidence_expected"), F.lit("region").alias("source"), F.col("r_regionkey").alias("order"))
    n = load(spark, sf_dir, "nation").select(F.concat(F.lit("Test "), "n_name").alias("requirement"), F.lit("test report").alias("evidence_expected"), F.lit("nation").alias("source"), F.col("n_nationkey").alias("order"))
    return planning.build_requirements([(r, "MANUAL", 3), (n, "TESTING", 15)], 12)


@query("SELECT l_linenumber AS file_id, count(*) AS n_rows FROM lineitem WHERE l_linenumber IN (1, 2) AND l_orderkey BETWEEN 100 AND 500 GROUP BY 1")
def row_window(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem")
    return planning.file_slice(line, "l_linenumber", "l_orderkey", [1, 2], 100, 500).groupBy(F.col("l_linenumber").alias("file_id")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT l_suppkey AS file_id, count(*) AS n_sheets, sum(l_quantity)::BIGINT AS n_rows, max(l_linenumber) AS n_columns, arg_min(l_returnflag, (-l_extendedprice, l_orderkey * 10 + l_linenumber)) AS domain FROM lineitem GROUP BY 1")
def file_rollup(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem")
    return planning.file_rollup(line.select(F.col("l_suppkey").alias("file_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sheet"), F.col("l_quantity").cast("long").alias("n_rows"), F.col("l_linenumber").alias("n_columns"), F.col("l_returnflag").alias("domain"), F.col("l_extendedprice").alias("score")))


@query("""WITH w AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type || ' thing' END AS product FROM part), e AS (SELECT p_partkey AS product_id, 'IS ' || p_size AS standard FROM part WHERE p_size > 25),
l AS (SELECT product, min(standard) AS linked FROM w JOIN part ON lower(trim(p_name)) = lower(trim(product)) JOIN e ON product_id = p_partkey GROUP BY 1),
k AS (SELECT DISTINCT 'IS ' || p_size AS standard, lower(p_type) AS word FROM part), t AS (SELECT DISTINCT product, unnest(regexp_split_to_array(lower(product), '[^a-z0-9]+')) AS word FROM w), h AS (SELECT product, standard, count(*) AS n FROM t JOIN k USING (word) WHERE length(word) >= 3 GROUP BY 1, 2),
f AS (SELECT product, arg_min(standard, (-n, standard)) AS found FROM h GROUP BY 1)
SELECT w.product, coalesce(linked, found) AS standard, CASE WHEN linked IS NOT NULL THEN 'LINKED' WHEN found IS NOT NULL THEN 'KEYWORD' ELSE 'NOT_FOUND' END AS how FROM w LEFT JOIN l ON l.product = w.product LEFT JOIN f ON f.product = w.product""")
def resolved_products(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    standard = F.concat(F.lit("IS "), F.col("p_size").cast("string")).alias("standard")
    wanted = part.select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_type", F.lit(" thing"))).alias("product")).distinct()
    edges = part.where("p_size > 25").select(F.col("p_partkey").alias("product_id"), standard)
    keywords = part.select(standard, F.lower("p_type").alias("word")).distinct()
    return planning.resolve_products(wanted, part.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name")), edges, keywords)


@query("SELECT o_orderkey AS id, unnest(CASE o_orderpriority WHEN '1-URGENT' THEN ['fast', 'all'] WHEN '2-HIGH' THEN ['fast', 'all'] WHEN '5-LOW' THEN ['all'] ELSE [] END) AS dataset FROM orders")
def manual_sections(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    return planning.sections(orders, "o_orderpriority", {"fast": ["1-URGENT", "2-HIGH"], "all": ["1-URGENT", "2-HIGH", "5-LOW"]}).select("id", "dataset")
