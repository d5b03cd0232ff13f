"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions.text import PLACEHOLDERS, cap, norm_header
from lumenfold.functions.values import cell_kind, infer_type, is_list
from lumenfold.operators import profile
from lumenfold.plans.registry import load, query

_MARKS = ", ".join(f"'{p}'" for p in PLACEHOLDERS)
NORM = rf"""CASE WHEN v IS NULL OR trim(v) = '' OR lower(trim(v)) IN ({_MARKS}) THEN ''
  WHEN regexp_matches(trim(v), '^[+-]?[0-9]+$') THEN CAST(CAST(trim(v) AS HUGEINT) AS VARCHAR)
  WHEN regexp_matches(trim(v), '^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$')
    THEN regexp_replace(regexp_replace(CAST(CAST(round(CAST(trim(v) AS DOUBLE), 10) AS DECIMAL(38, 10)) AS VARCHAR), '0+$', ''), '\.$', '')
  ELSE lower(regexp_replace(trim(v), '\s+', ' ', 'g')) END"""
KIND = r"""CASE WHEN v IS NULL OR trim(v) = '' THEN NULL WHEN regexp_matches(v, '(?i)https?://') THEN 'url'
  WHEN regexp_matches(trim(v), '^[+-]?[0-9]+$') THEN 'int'
  WHEN regexp_matches(trim(v), '^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$') THEN 'float'
  WHEN regexp_matches(v, '^\s*([0-9]{1,4}[/.-][0-9]{1,2}[/.-][0-9]{1,4})|^\s*[0-9]{1,2}\s+[A-Za-z]{3,9}\s+[0-9]{4}\s*$') THEN 'date'
  WHEN lower(trim(v)) IN ('true','false','yes','no','y','n','0','1') THEN 'bool' ELSE 'string' END"""
TYPE = """CASE WHEN len(ks) = 0 THEN 'empty' WHEN len(ks) = 1 THEN ks[1]
  WHEN len(list_filter(ks, lambda k: k NOT IN ('int','float'))) = 0 THEN 'float'
  WHEN len(list_filter(ks, lambda k: k NOT IN ('int','float','bool'))) = 0 THEN 'numeric_mixed'
  WHEN len(list_filter(ks, lambda k: k NOT IN ('url','string'))) = 0 THEN 'string'
  ELSE 'mixed(' || array_to_string(ks, '|') || ')' END"""


def _unpivot(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM {table}" for c in columns)


def _profile_sql(table: str, columns: list[str]) -> str:
    return rf"""WITH cells AS ({_unpivot(table, columns)}),
c AS (SELECT col, v, {NORM} AS n, {KIND} AS k, (v IS NULL OR trim(v) = '') AS e, coalesce(lower(trim(v)) IN ({_MARKS}), false) AS p,
        coalesce(length(v) >= 3 AND regexp_matches(v, '[;,|]|\band\b') AND regexp_matches(v, '[^\s]\s+[^\s]'), false) AS m FROM cells),
g AS (SELECT col, count(*) AS total, count(*) FILTER (e) AS nulls, count(*) FILTER (p) AS marks, count(*) FILTER (m AND NOT e AND NOT p) AS packed,
        count(DISTINCT n) FILTER (NOT e AND NOT p) AS uniq, coalesce(list_sort(list_distinct(list(k) FILTER (NOT e AND NOT p AND k IS NOT NULL))), []) AS ks FROM c GROUP BY col)
SELECT col AS "column", total AS total_rows, nulls AS null_rows, marks AS placeholder_rows, uniq AS unique_count,
  total - nulls - marks - uniq AS duplicate_count, round(100 * (total - nulls) / total, 2) AS percentage_populated,
  round(100 * (total - nulls - marks) / total, 2) AS percentage_informative,
  round(CASE WHEN total - nulls - marks > 0 THEN packed / (total - nulls - marks) ELSE 0.0 END, 4) AS multivalue_ratio, {TYPE} AS data_type FROM g"""


_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_EVENTS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@query(_profile_sql("customer", _CUSTOMER))
def profile_columns(spark, sf_dir):
    return profile.profile_columns(load(spark, sf_dir, "customer").select(*_CUSTOMER))


@query(_profile_sql("events", _EVENTS))
def profile_events(spark, sf_dir):
    return profile.profile_columns(load(spark, sf_dir, "events").select(*_EVENTS))


_TYPED = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query(f"WITH cells AS ({_unpivot('part', _TYPED)}), g AS (SELECT col, list_sort(list_distinct(list({KIND}))) AS ks FROM cells GROUP BY col) SELECT col AS \"column\", {TYPE} AS data_type FROM g")
def infer_types(spark, sf_dir):
    kinds = profile.cells(load(spark, sf_dir, "part").select(*_TYPED)).groupBy("column").agg(F.array_sort(F.collect_set(cell_kind(F.col("value")))).alias("ks"))
    return kinds.select("column", infer_type(F.col("ks")).alias("data_type"))


@query(r"""SELECT source, count(*) AS n, round(avg(CASE WHEN coalesce(length(text) >= 3 AND regexp_matches(text, '[;,|]|\band\b') AND regexp_matches(text, '[^\s]\s+[^\s]'), false) THEN 1.0 ELSE 0.0 END), 4) AS ratio
FROM documents GROUP BY source""")
def multivalue_ratio(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(is_list(F.col("text")), F.lit(False)).cast("double")), 4).alias("ratio"))


_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _norm(c: str) -> str:
    return NORM.replace("trim(v)", f"trim(CAST({c} AS VARCHAR))").replace("v IS NULL", f"{c} IS NULL")


@query(f"""WITH r AS (SELECT sha1(concat_ws(chr(31), {', '.join(f'({_norm(c)})' for c in _CUSTOMER)})) AS h,
  {' + '.join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in _CUSTOMER)} AS nulls FROM customer)
SELECT count(*) AS total_rows, count(*) AS non_blank_rows, sum(nulls)::BIGINT AS null_cells, 0::BIGINT AS placeholder_cells, count(DISTINCT h) AS unique_rows, count(*) - count(DISTINCT h) AS duplicate_rows FROM r""")
def table_profile(spark, sf_dir):
    return profile.table_profile(load(spark, sf_dir, "customer").select(*_CUSTOMER))


_FOLD = "sha256(concat_ws(':', CAST(sum(CAST(('0x' || left({h}, 15)) AS BIGINT)::HUGEINT) AS VARCHAR), CAST(bit_xor(CAST(('0x' || left({h}, 15)) AS BIGINT)) AS VARCHAR), CAST(count(*) AS VARCHAR)))"


@query(f"""WITH r AS (SELECT c_custkey AS k, left(sha1(concat_ws(chr(31), {', '.join(f'({_norm(c)})' for c in _CUSTOMER)})), 16) AS h FROM customer),
q AS (SELECT h, sha1(concat_ws(':', CAST(k AS VARCHAR), h)) AS placed FROM r)
SELECT count(*) AS n_rows, {_FOLD.format(h='h')} AS row_set_signature, {_FOLD.format(h='placed')} AS content_signature FROM q""")
def table_signature(spark, sf_dir):
    return profile.signatures(load(spark, sf_dir, "customer").select(*_CUSTOMER), "c_custkey")


_CELLS = ", ".join("(" + NORM.replace("trim(v)", f"regexp_replace(CAST({c} AS VARCHAR), '^[ \\t\\r\\n\\f\\x0B]+|[ \\t\\r\\n\\f\\x0B]+$', '', 'g')").replace("v IS NULL", f"{c} IS NULL") + ")" for c in ("text", "lang", "source", "n_chars"))


@query(f"""WITH r AS (SELECT doc_id, left(sha1(concat_ws(chr(31), {_CELLS})), 16) AS h FROM documents)
SELECT h AS row_hash, count(*) AS n_rows, min(doc_id) AS first_row, max(doc_id) AS last_row FROM r GROUP BY h HAVING count(*) > 1""")
def row_duplicates(spark, sf_dir):
    return profile.row_duplicates(load(spark, sf_dir, "documents"), ["text", "lang", "source", "n_chars"], "doc_id")


@query("""SELECT left(md5(text), 16) AS text_hash, count(*) AS n_rows, min(doc_id) AS first_row, max(doc_id) AS last_row FROM documents GROUP BY text HAVING count(*) > 1""")
def exact_copies(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    grouped = docs.groupBy("h").agg(F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("first_row"), F.max("doc_id").alias("last_row"))
    return grouped.where("n_rows > 1").select(F.substring("h", 1, 16).alias("text_hash"), "n_rows", "first_row", "last_row")


DOMAINS = [("LEGAL", ["licensed", "license", "rights reserved"], ["public", "version"]), ("CONTACT", ["@"], ["mail", "call"]), ("SECRET", ["password", "token ="], ["akia"])]


def _points(words: list[str], k: int) -> str:
    return " + ".join(f"(CASE WHEN contains(low, '{w}') THEN {k} ELSE 0 END)" for w in words)


@query(f"""WITH s AS (SELECT doc_id, {', '.join(f'{_points(s, 3)} + {_points(w, 1)} AS {n}' for n, s, w in DOMAINS)} FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents))
SELECT doc_id, CASE WHEN greatest(LEGAL, CONTACT, SECRET) < 1 THEN 'OTHER' WHEN LEGAL >= greatest(CONTACT, SECRET) THEN 'LEGAL' WHEN CONTACT >= SECRET THEN 'CONTACT' ELSE 'SECRET' END AS label, greatest(LEGAL, CONTACT, SECRET) AS score FROM s""")
def domain_classify(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    names = [d[0] for d in DOMAINS]
    scored = docs.select("doc_id", *profile.keyword_scores(F.col("text"), DOMAINS))
    return scored.select("doc_id", profile.best_rule([(n, F.col(n)) for n in names]).alias("b")).select("doc_id", "b.label", "b.score")


@query(r"""SELECT o_orderpriority AS raw, regexp_replace(regexp_replace(lower(o_orderpriority), '[^0-9a-z]+', '_', 'g'), '^_+|_+$', '', 'g') AS header, count(*) AS n FROM orders GROUP BY 1, 2""")
def header_names(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("raw")).agg(F.count(F.lit(1)).alias("n")).withColumn("header", norm_header(F.col("raw")))


@query("""WITH d AS (SELECT p_brand AS brand, list_sort(list_distinct(list(p_type))) AS ts FROM part GROUP BY 1)
SELECT brand, array_to_string(ts[1:3], '; ') || CASE WHEN len(ts) > 3 THEN ' …(+' || (len(ts) - 3) || ')' ELSE '' END AS types FROM d""")
def capped_lists(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    return part.groupBy(F.col("p_brand").alias("brand")).agg(F.collect_set("p_type").alias("ts")).select("brand", cap(F.col("ts"), 3).alias("types"))


@query("""WITH c AS (SELECT 'o_orderstatus' AS col, o_orderstatus AS v, min(o_orderkey) AS a FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'o_orderpriority', o_orderpriority, min(o_orderkey) FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 2),
r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY a, v) AS rk FROM c)
SELECT col AS "column", string_agg(left(v, 70), ' | ' ORDER BY rk) AS examples FROM r WHERE rk <= 3 GROUP BY col""")
def column_examples(spark, sf_dir):
    return profile.examples(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")


@query("""WITH t AS (SELECT CASE WHEN contains(lower(p_type), 'steel') THEN 'STEEL' WHEN contains(lower(p_type), 'brass') THEN 'BRASS' WHEN contains(lower(p_type), 'a') THEN 'ANY' END AS label FROM part),
c AS (SELECT label, count(*) AS n FROM t WHERE label IS NOT NULL GROUP BY label), b AS (SELECT sum(n) AS bearing FROM c)
SELECT 'p_type' AS "column", label, n, round(n / bearing, 4) AS ratio FROM c, b WHERE n / bearing >= 0.3 AND (n >= 3 OR n / bearing >= 0.5) ORDER BY n DESC, label LIMIT 1""")
def dominant_value(spark, sf_dir):
    return profile.dominant_value(load(spark, sf_dir, "part"), "p_type", [("(?i)steel", "STEEL"), ("(?i)brass", "BRASS"), ("(?i)a", "ANY")], share=0.3)
