"""Comparison and integrity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import compare, integrity
from lumenfold.plans.registry import load, query

_TABLES = ["customer", "lineitem", "nation", "orders", "part", "region", "supplier"]
_HEADERS = """SELECT table_name AS name, list_sort(list(regexp_replace(column_name, '^[a-z]+_', ''))) AS h FROM duckdb_columns() WHERE table_name IN ('customer','lineitem','nation','orders','part','region','supplier') GROUP BY table_name"""


@query(f"""WITH f AS ({_HEADERS}), p AS (SELECT a.name AS a, b.name AS b, a.h AS ha, b.h AS hb, len(list_intersect(a.h, b.h)) AS common, len(list_distinct(list_concat(a.h, b.h))) AS u FROM f a JOIN f b ON a.name < b.name)
SELECT a, b, common::INTEGER AS common, round(CASE WHEN u = 0 THEN 0 ELSE common / u END, 4) AS schema_jaccard,
CASE WHEN common = 0 THEN 'DISJOINT' WHEN common = len(ha) AND common = len(hb) THEN 'IDENTICAL' WHEN common = len(ha) OR common = len(hb) THEN 'SUBSET'
 WHEN round(common / u, 4) >= 0.6 THEN 'SUBSTANTIAL' WHEN round(common / u, 4) >= 0.25 THEN 'OVERLAP' ELSE 'WEAK' END AS verdict FROM p""")
def schema_compare(spark, sf_dir):
    facts = [(t, sorted(c.split("_", 1)[1] for c in load(spark, sf_dir, t).columns)) for t in _TABLES]
    return compare.schema_pairs(spark.createDataFrame(facts, "name string, headers array<string>"))


#: Two sides of the orders, most of which both have; row numbers are of each side's own making.
_SIDE = "SELECT '{p}-' || o_orderkey AS row_no, CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, lower(o_orderpriority) AS o_orderpriority FROM orders WHERE o_orderkey % {m} <> 0"
_SIDES = ["row_no", "o_orderkey", "o_custkey", "o_orderpriority"]


@query(f"WITH a AS ({_SIDE.format(p='a', m=3)}), b AS ({_SIDE.format(p='b', m=4)})" + " UNION ALL ".join(f""" SELECT * FROM (SELECT '{c}' AS "column", (SELECT count(DISTINCT {c}) FROM a) AS distinct_a, (SELECT count(DISTINCT {c}) FROM b) AS distinct_b, (SELECT count(*) FROM (SELECT {c} FROM a INTERSECT SELECT {c} FROM b)) AS shared,
 CASE WHEN (SELECT count(*) FROM (SELECT {c} FROM a INTERSECT SELECT {c} FROM b)) = 0 THEN 'SURROGATE' ELSE 'KEY' END AS role) WHERE distinct_a >= 0.95 * (SELECT count(*) FROM a) AND distinct_b >= 0.95 * (SELECT count(*) FROM b)""" for c in _SIDES))
def key_discovery(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    side = lambda p, m: orders.where(F.col("o_orderkey") % m != 0).select(F.concat(F.lit(f"{p}-"), F.col("o_orderkey").cast("string")).alias("row_no"), *_SIDES[1:])
    return compare.key_candidates(side("a", 3), side("b", 4))


@query("""WITH b AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN upper(s_name) || ' ' WHEN s_suppkey % 5 = 0 THEN s_name || ' Ltd' ELSE s_name END AS s_name, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE s_nationkey + (CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END) END AS s_nationkey FROM supplier),
u AS (SELECT CAST(a.s_suppkey AS VARCHAR) AS key, 's_name' AS col, a.s_name AS x, b.s_name AS y FROM supplier a JOIN b USING (s_suppkey)
  UNION ALL SELECT CAST(a.s_suppkey AS VARCHAR), 's_nationkey', CAST(a.s_nationkey AS VARCHAR), CAST(b.s_nationkey AS VARCHAR) FROM supplier a JOIN b USING (s_suppkey))
SELECT key, col AS "column", x AS value_a, y AS value_b, CASE WHEN lower(trim(x)) = lower(trim(y)) THEN 'FORMAT_VARIANT' ELSE 'DISAGREEMENT' END AS kind FROM u WHERE x IS NOT NULL AND y IS NOT NULL AND x <> y""")
def record_conflicts(spark, sf_dir):
    a = load(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return compare.record_conflicts(a, _changed_suppliers(a), "s_suppkey", ["s_name", "s_nationkey"])


def _changed_suppliers(a):
    key = F.col("s_suppkey")
    name = F.when(key % 7 == 0, F.concat(F.upper("s_name"), F.lit(" "))).when(key % 5 == 0, F.concat("s_name", F.lit(" Ltd"))).otherwise(F.col("s_name"))
    return a.select("s_suppkey", name.alias("s_name"), F.when(key % 11 != 0, F.col("s_nationkey") + (key % 3 == 0).cast("int")).alias("s_nationkey"))


@query("""WITH a AS (SELECT l_partkey, l_suppkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL), b AS (SELECT l_partkey, l_suppkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_linenumber >= 2 GROUP BY ALL),
j AS (SELECT coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb FROM a FULL JOIN b USING (l_partkey, l_suppkey, l_returnflag)),
s AS (SELECT sum(na)::BIGINT AS rows_a, sum(nb)::BIGINT AS rows_b, sum(least(na, nb))::BIGINT AS common_rows FROM j)
SELECT *, round(common_rows / (rows_a + rows_b - common_rows), 4) AS row_jaccard FROM s""")
def row_multiset_overlap(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_linenumber")
    return compare.row_overlap(line.where("l_linenumber <= 2"), line.where("l_linenumber >= 2"), ["l_partkey", "l_suppkey", "l_returnflag"])


_STOP = "('the','a','an','of','for','and','or','in','with','type','types','other','general','all','its','to','on','by','s')"
_STEM = "CASE WHEN length(t) > 4 AND t LIKE '%ies' THEN left(t, length(t) - 3) || 'y' WHEN length(t) > 4 AND t LIKE '%ses' THEN left(t, length(t) - 3) WHEN length(t) > 4 AND t LIKE '%es' THEN left(t, length(t) - 2) WHEN length(t) > 4 AND t LIKE '%s' THEN left(t, length(t) - 1) ELSE t END"
_TOK = f"list_distinct(list_transform(list_filter(regexp_split_to_array(lower({{c}}), '[^0-9a-z]+'), lambda t: t <> '' AND t NOT IN {_STOP}), lambda t: {_STEM}))"


@query(f"""WITH n AS (SELECT min(p_partkey) AS id, p_name AS x, {_TOK.format(c='p_name')} AS tx FROM part WHERE p_name IS NOT NULL GROUP BY p_name),
p AS (SELECT a.id AS id_a, b.id AS id_b, a.x AS x, b.x AS y, a.tx AS ta, b.tx AS tb FROM n a JOIN n b ON a.id < b.id UNION ALL SELECT n.id, p_partkey, x, x, tx, tx FROM n JOIN part ON p_name = x AND p_partkey <> n.id),
c AS (SELECT *, len(list_intersect(ta, tb)) AS i, len(list_distinct(list_concat(ta, tb))) AS u, len(ta) AS na, len(tb) AS nb FROM p),
r AS (SELECT id_a, id_b, CASE WHEN x = y THEN 'EXACT_DUPLICATE' WHEN na = 0 OR nb = 0 THEN 'DIFFERENT_ENTITY' WHEN i = na AND i = nb THEN 'LIKELY_DUPLICATE' WHEN i / u >= 0.6 OR i = na OR i = nb THEN 'LIKELY_DUPLICATE' WHEN i / u >= 0.34 THEN 'RELATED_RECORD' ELSE 'DIFFERENT_ENTITY' END AS cls,
 CASE WHEN x = y THEN 1.0 WHEN na = 0 OR nb = 0 THEN 0.0 WHEN i = na AND i = nb THEN 0.99 ELSE round(i / u, 4) END AS score, round(CASE WHEN u = 0 THEN 0 ELSE i / u END, 4) AS token_jaccard FROM c)
SELECT * FROM r WHERE cls <> 'DIFFERENT_ENTITY'""")
def name_similarity(spark, sf_dir):
    return compare.similar_names(load(spark, sf_dir, "part"), "p_partkey", "p_name")


_REFS = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("labels", "doc_id", "documents", "doc_id"), ("documents", "doc_id", "labels", "doc_id")]


@query(" UNION ALL ".join(f"SELECT '{c}.{k}' AS reference, count(*) AS orphan_rows, count(DISTINCT {k}) AS orphan_keys FROM {c} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {pk} FROM {p} WHERE {pk} IS NOT NULL)" for c, k, p, pk in _REFS))
def orphan_check(spark, sf_dir):
    return integrity.union_all([integrity.orphan_check(load(spark, sf_dir, c), k, load(spark, sf_dir, p), pk, f"{c}.{k}") for c, k, p, pk in _REFS])


_KEYS = [("region", "r_regionkey"), ("customer", "c_custkey"), ("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("documents", "doc_id"), ("conversations", "conv_id")]


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{k}' AS key_column, count(*) AS n_rows, count(*) FILTER ({k} IS NULL) AS blank_keys, count({k}) - count(DISTINCT {k}) AS duplicate_rows, (SELECT count(*) FROM (SELECT {k} FROM {t} WHERE {k} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS repeated_keys FROM {t}" for t, k in _KEYS))
def key_check(spark, sf_dir):
    return integrity.union_all([integrity.key_check(load(spark, sf_dir, t), t, k) for t, k in _KEYS])


_COMPLETE = ["doc_id", "text", "lang", "source", "n_chars"]


@query(" UNION ALL ".join(f"SELECT 'documents' AS table_name, '{c}' AS \"column\", count(*) AS n_rows, count(*) FILTER ({c} IS NOT NULL AND trim(CAST({c} AS VARCHAR)) <> '') AS filled, round(100 * count(*) FILTER ({c} IS NOT NULL AND trim(CAST({c} AS VARCHAR)) <> '') / count(*), 2) AS percentage FROM documents" for c in _COMPLETE))
def completeness(spark, sf_dir):
    return integrity.completeness(load(spark, sf_dir, "documents"), "documents")


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1")
def vocabulary_check(spark, sf_dir):
    return integrity.vocabulary_check(load(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"])


@query("""SELECT CASE WHEN o.k IS NULL THEN 'lineitem_only' WHEN l.k IS NULL THEN 'orders_only' ELSE 'both' END AS status, count(*) AS n_keys
FROM (SELECT DISTINCT o_orderkey AS k FROM orders) o FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON o.k = l.k GROUP BY 1""")
def key_coverage(spark, sf_dir):
    o, l = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")  # noqa: E741
    return integrity.coverage(o.select(F.col("o_orderkey").alias("k")), l.select(F.col("l_orderkey").alias("k")), "k", "orders", "lineitem")


@query("""SELECT t.table_name, t.expected, f.found, t.expected = f.found AS ok FROM (VALUES ('region', 5::BIGINT), ('nation', 26::BIGINT)) t(table_name, expected)
JOIN (SELECT 'region' AS table_name, count(*) AS found FROM region UNION ALL SELECT 'nation', count(*) FROM nation) f USING (table_name)""")
def row_reconcile(spark, sf_dir):
    found = integrity.union_all([load(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t in ("region", "nation")])
    return integrity.row_reconcile(spark.createDataFrame([("region", 5), ("nation", 26)], "table_name string, n_rows long"), found)
