"""Cells, numbers and lists normalised over whole tables; leaks, quarantine, groups of copies, first rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import standards, values
from lumenfold.functions.text import missing_reason, null_class, value
from lumenfold.operators import compare, integrity, profile, retrieve
from lumenfold.plans.registry import load, query
from lumenfold.storage import spread


@query("""SELECT p_partkey AS id, (['MANDATORY', 'VOLUNTARY', 'BOTH', 'UNKNOWN', 'OTHER', 'UNKNOWN'])[p_partkey % 6 + 1] AS mandatory,
 CASE p_partkey % 6 WHEN 0 THEN 'CM/L-' || (1000000 + p_partkey) WHEN 1 THEN 'CM/L-' || (50000 + p_partkey) WHEN 2 THEN 'applied for' WHEN 4 THEN 'CM/L-77' ELSE '' END AS licence_no, (['CML', 'DIGITS_ONLY', 'LABEL', 'EMPTY', 'CML', 'EMPTY'])[p_partkey % 6 + 1] AS licence_class,
 p_name || '/co' AS name, CASE p_partkey % 6 WHEN 3 THEN 'SOURCE_PLACEHOLDER_AMBIGUOUS' WHEN 5 THEN 'SOURCE_CELL_EMPTY' ELSE '' END AS reason, CASE p_partkey % 6 WHEN 0 THEN 'Mandatory under an order' WHEN 1 THEN 'voluntary' WHEN 2 THEN 'compulsory or optional' WHEN 4 THEN 'see order' ELSE '' END AS value FROM part""")
def cell_values(spark, sf_dir):
    k = F.col("p_partkey")
    pick = lambda *cells: F.element_at(F.array(*[c if not isinstance(c, str | None) else F.lit(c).cast("string") for c in cells]), (k % 6 + 1).cast("int"))
    rule = pick("Mandatory  under an order", "voluntary", "compulsory or optional", "N/A", "see order", None)
    licence = pick(F.concat(F.lit("licence CM/L-"), (1000000 + k).cast("string")), F.concat(F.lit("no "), (50000 + k).cast("string")), "applied for", "N/A", "CML 77", None)
    rows = load(spark, sf_dir, "part").select(k.alias("id"), rule.alias("rule"), licence.alias("licence"), F.concat(F.lit("- "), "p_name", F.lit(" / co. ")).alias("name"))
    found = values.nlicence(F.col("licence"))
    return rows.select("id", values.nmandatory(F.col("rule")).alias("mandatory"), found["licence_no"].alias("licence_no"), found["cls"].alias("licence_class"), values.nname(F.col("name")).alias("name"), missing_reason(null_class(F.col("rule"))).alias("reason"), value(F.col("rule")).alias("value"))


@query("SELECT p_partkey AS id, 'IS 302 (Part ' || p_size || ')' AS first, 'PARSED_FIRST_OF_3' AS status, 2 AS n_distinct, 'IS/IEC ' || (60000 + p_size) || '-1' AS last FROM part")
def standard_numbers(spark, sf_dir):
    size = F.col("p_size")
    text = F.concat(F.lit("as per IS:302 (Part "), size.cast("string"), F.lit("): 2008, is 302 pt "), size.cast("string"), F.lit(" and IS / IEC "), (60000 + size).cast("string"), F.lit("-1"))
    rows = spread(load(spark, sf_dir, "part").select("p_partkey", "p_size")).select(F.col("p_partkey").alias("id"), text.alias("t"))
    made = rows.select("id", standards.first_number(F.col("t")).alias("f"), standards.distinct_numbers(F.col("t")).alias("every"))
    return made.select("id", F.col("f.canonical").alias("first"), "f.status", F.size("every").alias("n_distinct"), F.element_at("every", -1)["canonical"].alias("last"))


@query("SELECT p_partkey AS id, CASE WHEN lower(p_type) = lower(p_name) THEN p_name ELSE p_name || ' | ' || p_type END AS members, CASE WHEN p_partkey % 2 = 0 THEN 'S.O. ' || p_partkey || '(E) dated 5 May 2020' ELSE 'No. ' || p_partkey || ' of 2019-20' END AS number FROM part")
def packed_cells(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    number = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("S.O."), k, F.lit(" ( e ) Date 5 May 2020."))).otherwise(F.concat(F.lit("no: "), k, F.lit(" of 2019 / 20")))
    rows = spread(load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")).select(F.col("p_partkey").alias("id"), F.concat_ws("; ", "p_name", "p_type", F.upper("p_name"), F.lit("n/a")).alias("list"), number.alias("number"))
    return rows.select("id", F.array_join(values.split_list(F.col("list")), " | ").alias("members"), values.nnotification(F.col("number")).alias("number"))


@query("""SELECT col AS "column", count(*) FILTER (lower(trim(v)) IN ('n/a', 'none', 'unknown')) AS leaks FROM (SELECT unnest(['p_name', 'p_type']) AS col, unnest([CASE WHEN p_partkey % 5 = 0 THEN ' N/A' WHEN p_partkey % 5 = 1 THEN '' ELSE p_name END, CASE WHEN p_partkey % 9 = 0 THEN 'None' WHEN p_partkey % 9 = 1 THEN 'unknown' ELSE p_type END]) AS v FROM part) GROUP BY 1""")
def placeholder_leaks(spark, sf_dir):
    k = F.col("p_partkey")
    part = load(spark, sf_dir, "part").select(F.when(k % 5 == 0, " N/A").when(k % 5 == 1, "").otherwise(F.col("p_name")).alias("p_name"), F.when(k % 9 == 0, "None").when(k % 9 == 1, "unknown").otherwise(F.col("p_type")).alias("p_type"))
    return integrity.placeholder_leaks(part, ["p_name", "p_type"])


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'source,target' WHEN o_orderkey % 2 = 0 THEN 'source' ELSE 'target' END AS missing_ends FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def quarantined(spark, sf_dir):
    k = F.col("o_orderkey")
    edges = load(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 2 != 0, F.col("o_custkey")).alias("source"), F.when(k % 3 != 0, "x").otherwise(" ").alias("target"))
    return integrity.quarantine(edges, ["source", "target"])[1].select("id", "missing_ends")


@query(r"""WITH f AS (SELECT doc_id AS file_id, md5(text) AS a, md5(lower(trim(regexp_replace(text, '[\x09-\x0D ]+', ' ', 'g')))) AS b, source AS c FROM documents WHERE text IS NOT NULL), n AS (SELECT *, count(*) OVER (PARTITION BY a) AS na, min(file_id) OVER (PARTITION BY a) AS fa, count(*) OVER (PARTITION BY b) AS nb, min(file_id) OVER (PARTITION BY b) AS fb, CASE WHEN c IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY c) END AS nc, min(file_id) OVER (PARTITION BY c) AS fc FROM f)
SELECT file_id, CASE WHEN na > 1 THEN 'BYTES' WHEN nb > 1 THEN 'CONTENT' ELSE 'NAME' END AS basis, CASE WHEN na > 1 THEN fa WHEN nb > 1 THEN fb ELSE fc END AS group_id FROM n WHERE na > 1 OR nb > 1 OR nc > 1""")
def duplicate_groups(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").where("text IS NOT NULL")
    return profile.duplicate_groups(docs.select(F.col("doc_id").alias("file_id"), F.md5("text").alias("sha256"), F.md5(F.lower(F.trim(F.regexp_replace("text", r"[\x09-\x0D ]+", " ")))).alias("content"), F.col("source").alias("family")))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber::BIGINT * 1000000000 + l_partkey) AS n FROM lineitem) WHERE n = 1")
def first_rows(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_linenumber") * F.lit(1000000000).cast("long") + F.col("l_partkey")).alias("at"))
    return compare.first_by_key(line, "l_orderkey", "at").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT c_custkey AS pair, array_to_string(list_filter([CASE WHEN c_nationkey < 5 THEN 'SAME_GROUP' END, CASE WHEN c_acctbal > 5000 THEN 'SCHEMA' END, CASE WHEN c_custkey % 3 = 0 THEN 'ENTITIES' END], lambda x: x IS NOT NULL), ',') AS reasons FROM customer")
def deep_gate(spark, sf_dir):
    pairs = load(spark, sf_dir, "customer")
    reasons = compare.deep_gate({"SAME_GROUP": F.col("c_nationkey") < 5, "SCHEMA": F.col("c_acctbal") > 5000, "ENTITIES": F.col("c_custkey") % 3 == 0})
    return pairs.select(F.col("c_custkey").alias("pair"), F.array_join(reasons, ",").alias("reasons"))


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE 'cold %' ORDER BY p_name, p_partkey LIMIT 1")
def prefix_lookup(spark, sf_dir):
    return retrieve.exact_or_prefix(load(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "COLD ", "p_partkey")


@query("SELECT * FROM (SELECT 'orders' AS file_id, 'o_orderkey' AS \"column\", 1::INT AS rank UNION ALL SELECT 'orders', 'o_custkey', 2)")
def key_ranking(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    shared = {c: compare.key_overlap(orders, orders.select((F.col(c) * 2).alias(c)), c).select(F.lit(c).alias("column"), "jaccard") for c in orders.columns}
    facts = shared["o_orderkey"].unionByName(shared["o_custkey"]).select("column", (F.col("jaccard") > 0).alias("shares"), (F.col("column") == "o_orderkey").alias("entity"), F.col("jaccard").alias("overlap"))
    return compare.rank_keys(facts).select(F.lit("orders").alias("file_id"), "column", "rank")


#: Edges of orders that were set aside: some have their row number where the file's id should be.
_SET_ASIDE = """SELECT o_orderkey AS quarantine_id, CASE WHEN o_orderkey % 3 = 0 THEN 'NOTES' ELSE 'LINKS' END AS origin, o_orderpriority AS evidence_value, 'file ' || o_orderkey % 5 AS source_file, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS source_file_id, '' AS source_sheet,
 CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS source_row, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_orderkey % 30 AS VARCHAR) END AS resolved_id, '' AS resolved_label FROM orders WHERE o_orderstatus = 'P'"""


@query(f"""WITH q AS ({_SET_ASIDE}), f AS (SELECT *, CASE WHEN source_row <> '' THEN source_row ELSE source_file_id END AS rowno, CASE WHEN source_file <> 'file 4' THEN 'F' || right(source_file, 1) ELSE '' END AS fid FROM q),
notes AS (SELECT o_orderpriority AS v, CAST(o_custkey AS VARCHAR) AS r, min((CAST(o_orderkey % 25 AS VARCHAR), 'N' || o_orderkey % 7, 's' || o_orderkey % 3)) AS x FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2), sheets AS (SELECT 'F' || c_custkey % 5 AS file_id, CAST(c_custkey AS VARCHAR) AS r, c_mktsegment AS sheet FROM customer)
SELECT quarantine_id, origin, CASE WHEN origin = 'NOTES' AND x IS NOT NULL THEN x[2] ELSE fid END AS source_file_id, CASE WHEN origin = 'NOTES' THEN coalesce(x[3], '') ELSE coalesce(sheet, '') END AS source_sheet, rowno AS source_row,
 CASE WHEN origin = 'NOTES' THEN coalesce(x[1], '') ELSE resolved_id END AS resolved_id, coalesce(n_name, '') AS resolved_label
FROM f LEFT JOIN notes ON origin = 'NOTES' AND v = evidence_value AND notes.r = rowno LEFT JOIN sheets ON origin <> 'NOTES' AND file_id = fid AND sheets.r = rowno
LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = CASE WHEN origin = 'NOTES' THEN coalesce(x[1], '') ELSE resolved_id END""")
def repaired_edges(spark, sf_dir):
    """Repaired twice: the second time changes nothing."""
    orders, nation, k, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "nation"), F.col("o_orderkey"), F.col("o_custkey").cast("string")
    text = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    bad = orders.where("o_orderstatus = 'P'").select(
        k.alias("quarantine_id"), F.when(k % 3 == 0, "NOTES").otherwise("LINKS").alias("origin"), F.col("o_orderpriority").alias("evidence_value"), text("file ", k % 5).alias("source_file"), F.when(k % 4 == 0, c).otherwise("").alias("source_file_id"), F.lit("").alias("source_sheet"),
        F.when(k % 4 == 0, "").otherwise(c).alias("source_row"), F.when(k % 3 == 0, "").otherwise((k % 30).cast("string")).alias("resolved_id"), F.lit("").alias("resolved_label"),
    )
    files = nation.where("n_nationkey < 4").select(text("file ", F.col("n_nationkey")).alias("name"), text("F", F.col("n_nationkey")).alias("file_id"))
    notes = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderpriority").alias("evidence_value"), c.alias("row_no"), (k % 25).cast("string").alias("resolved_id"), text("N", k % 7).alias("file_id"), text("s", k % 3).alias("sheet"))
    key = F.col("c_custkey")
    sheets = load(spark, sf_dir, "customer").select(text("F", key % 5).alias("file_id"), key.cast("string").alias("row_no"), F.col("c_mktsegment").alias("sheet"))
    labels = nation.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("label"))
    once = integrity.repaired(bad, files, notes, sheets, labels, "NOTES")
    return integrity.repaired(once, files, notes, sheets, labels, "NOTES").select("quarantine_id", "origin", "source_file_id", "source_sheet", "source_row", "resolved_id", "resolved_label")
