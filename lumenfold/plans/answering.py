"""Question queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions.text import detect_language
from lumenfold.operators import answer
from lumenfold.plans.registry import load, query

#: A question of each kind about a part, by the part's number.
_ASKED = """SELECT p_partkey AS id, CASE p_partkey % 16 WHEN 0 THEN 'Compare IS ' || (100 + p_size) || ' and IS ' || (300 + p_size) WHEN 1 THEN 'please verify licence ' || p_partkey WHEN 2 THEN 'I manufacture ' || p_name || ', what compliance applies' WHEN 3 THEN 'what labs handle ' || p_name
 WHEN 4 THEN 'tests for IS ' || (100 + p_size) WHEN 5 THEN 'QCO ' || p_size || ' details' WHEN 6 THEN 'what is scheme ii' WHEN 7 THEN 'IS ' || (100 + p_size) WHEN 8 THEN 'which standard for ' || p_name WHEN 9 THEN p_name WHEN 10 THEN 'is it ok' WHEN 11 THEN 'compare IS ' || (100 + p_size) || ' chair'
 WHEN 12 THEN 'IS ' || (100 + p_size) || ' chair document' WHEN 13 THEN 'IS ' || (100 + p_size) || ' chair certification' WHEN 14 THEN 'all bis pathway' ELSE 'manufactur and testing ' || p_name END AS text FROM part"""


@query(f"""SELECT id, CASE id % 16 WHEN 0 THEN 'COMPARISON' WHEN 1 THEN 'VERIFICATION' WHEN 2 THEN 'COMPLIANCE_WORKFLOW' WHEN 3 THEN 'LAB_LOOKUP' WHEN 4 THEN 'TEST_LOOKUP' WHEN 5 THEN 'QCO_LOOKUP' WHEN 6 THEN 'SCHEME_LOOKUP' WHEN 7 THEN 'SIMPLE_LOOKUP' WHEN 8 THEN 'STANDARD_DISCOVERY'
 WHEN 9 THEN 'PRODUCT_DISCOVERY' WHEN 10 THEN 'GENERAL_BIS' WHEN 11 THEN 'COMPARISON' WHEN 12 THEN 'DOCUMENT_RESEARCH' WHEN 13 THEN 'CERTIFICATION_GUIDANCE' ELSE 'COMPLIANCE_WORKFLOW' END AS task,
 CASE WHEN id % 16 IN (0, 1, 2, 8, 11, 12, 13, 14, 15) THEN 'AGENT' ELSE 'SIMPLE' END AS mode FROM ({_ASKED})""")
def question_intents(spark, sf_dir):
    k, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    number = F.concat(F.lit("IS "), (100 + size).cast("string"))
    text = [
        F.concat(F.lit("Compare "), number, F.lit(" and IS "), (300 + size).cast("string")), F.concat(F.lit("please verify licence "), k.cast("string")), F.concat(F.lit("I manufacture "), name, F.lit(", what compliance applies")), F.concat(F.lit("what labs handle "), name),
        F.concat(F.lit("tests for "), number), F.concat(F.lit("QCO "), size.cast("string"), F.lit(" details")), F.lit("what is scheme ii"), number, F.concat(F.lit("which standard for "), name), name, F.lit("is it ok"), F.concat(F.lit("compare "), number, F.lit(" chair")),
        F.concat(number, F.lit(" chair document")), F.concat(number, F.lit(" chair certification")), F.lit("all bis pathway"), F.concat(F.lit("manufactur and testing "), name),
    ]
    asked = load(spark, sf_dir, "part").select(k.alias("id"), F.element_at(F.array(*text), (k % 16 + 1).cast("int")).alias("text"))
    return answer.classify_task(answer.extract_entities(asked)).select("id", "task", "mode")


@query(r"""SELECT role, count(*) AS n, count(*) FILTER (regexp_matches(lower(text), 'test')) AS wants_tests, count(*) FILTER (contains(lower(text), 'lab')) AS wants_labs, count(*) FILTER (regexp_matches(text, '[\x{0900}-\x{097F}]')) AS hindi FROM conversations GROUP BY role""")
def conversation_entities(spark, sf_dir):
    turns = answer.extract_entities(load(spark, sf_dir, "conversations"))
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return turns.groupBy("role").agg(F.count(F.lit(1)).alias("n"), count(F.col("wants_tests")).alias("wants_tests"), count(F.col("wants_labs")).alias("wants_labs"), count(detect_language(F.col("text")) == "hi").alias("hindi"))


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN md5(text) END AS topic FROM conversations)
SELECT conv_id, turn, topic, last_value(topic IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS known_topic FROM t""")
def conversation_fold(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.md5("text")).alias("topic"))
    return answer.fold_memory(turns, "conv_id", "turn", ["topic"])


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 2")
def last_messages(spark, sf_dir):
    return answer.last_messages(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 2)


@query("""WITH q AS (SELECT c_custkey AS id, (['SIMPLE_LOOKUP', 'VERIFICATION', 'QCO_LOOKUP', 'TEST_LOOKUP', 'LAB_LOOKUP', 'COMPLIANCE_WORKFLOW'])[c_custkey % 6 + 1] AS task, CASE WHEN c_custkey % 12 = 1 THEN 'VALIDATED' END AS verdict FROM customer),
o AS (SELECT o_custkey AS id, list_sort(list(DISTINCT o_orderpriority)) AS ps, list_sort(list(DISTINCT o_orderstatus)) AS ss FROM orders GROUP BY 1),
e AS (SELECT o_custkey AS id, count(*) AS n, arg_max(o_orderpriority, (o_totalprice, o_orderpriority)) AS top FROM orders WHERE o_totalprice > 200000 GROUP BY 1),
j AS (SELECT q.*, n_name AS number, CASE WHEN q.id % 5 > 0 THEN 'title ' || q.id END AS title, ps, CASE WHEN q.id % 4 > 0 THEN ss ELSE [] END AS ss, n, top FROM q LEFT JOIN o ON o.id = q.id LEFT JOIN (SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 > 0) x ON x.c_custkey = q.id AND o.id IS NOT NULL LEFT JOIN e ON e.id = q.id)
SELECT id AS question_id, CASE WHEN number IS NULL AND n IS NULL THEN 'This can''t be determined reliably from the evidence that is there.' ELSE concat_ws(' ', CASE WHEN task = 'VERIFICATION' THEN 'Verification result: ' || coalesce(verdict, 'NOT_VERIFIED') || '.' END,
 CASE WHEN number IS NOT NULL THEN (CASE WHEN task = 'SIMPLE_LOOKUP' THEN 'Applicable standard: ' ELSE 'Resolving against ' END) || number || ': ' || coalesce(title, 'title not established') || '.' END,
 CASE WHEN number IS NOT NULL AND len(ps) > 0 THEN 'Products: ' || array_to_string(ps[1:3], '; ') || '.' END, CASE WHEN number IS NOT NULL AND len(ss) > 0 THEN 'Orders: ' || array_to_string(ss[1:3], '; ') || '.' END,
 CASE WHEN number IS NOT NULL AND task IN ('QCO_LOOKUP', 'COMPLIANCE_WORKFLOW') AND len(ss) = 0 THEN 'No order is linked to this standard; whether it is mandatory is UNKNOWN.' END,
 CASE WHEN number IS NOT NULL AND task = 'TEST_LOOKUP' THEN 'No tests are recorded for this standard (UNKNOWN).' END, CASE WHEN number IS NOT NULL THEN 'Laboratories (' || len(ps) || ' found): ' || array_to_string(ps[1:3], '; ') || '.' END,
 CASE WHEN number IS NULL AND n IS NOT NULL THEN 'Answered from evidence; no record was resolved.' END, CASE WHEN n IS NOT NULL THEN 'Supporting evidence: ' || n || ' cited, best match ' || chr(39) || top || chr(39) || '.' END) END AS answer,
 CASE WHEN number IS NULL AND n IS NULL THEN 'UNKNOWN' ELSE 'COMPLETED' END AS status FROM j""")
def answers(spark, sf_dir):
    customer, orders, nation = (load(spark, sf_dir, t) for t in ("customer", "orders", "nation"))
    k = F.col("c_custkey")
    tasks = ["SIMPLE_LOOKUP", "VERIFICATION", "QCO_LOOKUP", "TEST_LOOKUP", "LAB_LOOKUP", "COMPLIANCE_WORKFLOW"]
    questions = customer.select(k.alias("question_id"), F.element_at(F.array(*map(F.lit, tasks)), (k % 6 + 1).cast("int")).alias("task"), F.when(k % 12 == 1, "VALIDATED").alias("verdict"))
    lists = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("products"), F.array_sort(F.collect_set("o_orderstatus")).alias("orders"))
    nothing = F.array().cast("array<string>")
    bundles = customer.where(k % 3 > 0).join(nation, F.col("n_nationkey") == F.col("c_nationkey")).join(lists, F.col("o_custkey") == k)
    bundles = bundles.select(k.alias("question_id"), F.col("n_name").alias("number"), F.when(k % 5 > 0, F.concat(F.lit("title "), k.cast("string"))).alias("title"), "products", F.when(k % 4 > 0, F.col("orders")).otherwise(nothing).alias("orders"), nothing.alias("schemes"), nothing.alias("tests"), F.col("products").alias("labs"))
    evidence = orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("question_id"), F.col("o_orderpriority").alias("title"), F.col("o_totalprice").alias("score"))
    return answer.answers(questions, bundles, evidence)
