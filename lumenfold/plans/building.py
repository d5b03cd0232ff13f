"""The canonical build from parts, a changed copy of them, and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import canonical
from lumenfold.plans.conflicting import _COPY, _OWN, _copy, _parts
from lumenfold.plans.registry import load, query
from lumenfold.storage import written

MODEL = canonical.Model(
    routes={"F1": "PRODUCT", "F2": "PRODUCT", "F3": "SUPPLIER"},
    columns={
        ("PRODUCT", "p_name"): ("name", "FIELD"), ("PRODUCT", "p_size"): ("size", "FIELD"), ("PRODUCT", "p_brand"): ("brand", "EDGE"), ("PRODUCT", "p_type"): ("type", "ATTRIBUTE"),
        ("SUPPLIER", "s_name"): ("name", "FIELD"), ("SUPPLIER", "s_nationkey"): ("country", "EDGE"), ("SUPPLIER", "s_acctbal"): ("balance", "PROVENANCE"),
    },
    edges={("PRODUCT", "brand"): ("HAS_BRAND", "BRAND", "&amp;"), ("SUPPLIER", "country"): ("IN_COUNTRY", "COUNTRY", None)},
    keys={"PRODUCT": [["p_name", "p_type"], ["p_name"]], "SUPPLIER": [["s_name"]]},
    labels={"PRODUCT": "name", "SUPPLIER": "name", "BRAND": "brand_name"},
    prefixes={"PRODUCT": "PRD", "SUPPLIER": "SUP", "BRAND": "BRD", "COUNTRY": "CTR"},
    policies={"name": "LONGEST", "size": "KEY_IDENTITY"},
)

_ROWS = f"""WITH rows AS (SELECT 'F1' AS f, * FROM ({_OWN}) UNION ALL SELECT 'F2', * FROM ({_COPY})),
p AS (SELECT f, p_partkey AS r, lower(trim(p_name)) || '|' || lower(trim(p_type)) AS key, trim(p_name) AS name, p_size AS size, CASE WHEN p_brand = 'n/a' THEN NULL ELSE trim(p_brand) END AS brand, trim(p_type) AS type FROM rows),
s AS (SELECT 'F3' AS f, s_suppkey AS r, lower(trim(s_name)) AS key, trim(s_name) AS name, CAST(s_nationkey AS VARCHAR) AS country, s_acctbal AS balance FROM supplier),
refs AS (SELECT 'PRODUCT' AS entity, key, 'HAS_BRAND' AS relation, 'BRAND' AS to_entity, lower(trim(m)) AS to_key, trim(m) AS value, f, r FROM (SELECT *, unnest(string_split(brand, '&amp;')) AS m FROM p WHERE brand IS NOT NULL) WHERE trim(m) <> ''
  UNION ALL SELECT 'SUPPLIER', key, 'IN_COUNTRY', 'COUNTRY', country, country, f, r FROM s WHERE country IS NOT NULL),
own AS (SELECT DISTINCT 'PRODUCT' AS entity, key FROM p UNION SELECT DISTINCT 'SUPPLIER', key FROM s),
every AS (SELECT * FROM own UNION SELECT DISTINCT to_entity, to_key FROM refs),
ids AS (SELECT entity, key, CASE entity WHEN 'PRODUCT' THEN 'PRD-' WHEN 'SUPPLIER' THEN 'SUP-' WHEN 'BRAND' THEN 'BRD-' ELSE 'CTR-' END || lpad(CAST(row_number() OVER (PARTITION BY entity ORDER BY key) AS VARCHAR), 5, '0') AS id, (entity, key) IN (SELECT (entity, key) FROM own) AS direct FROM every)"""


def _build(spark, sf_dir):
    a = _parts(spark, sf_dir)
    files = {"F1": (a, "p_partkey"), "F2": (_copy(a), "p_partkey"), "F3": (load(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), "s_suppkey")}
    rows = written(canonical.project_all(files, MODEL), "rows")
    refs = written(canonical.references(rows, MODEL), "references")
    return rows, refs, written(canonical.mint(rows, refs, MODEL), "ids")


@query(f"{_ROWS} SELECT entity, key, id, direct FROM ids")
def canonical_ids(spark, sf_dir):
    return _build(spark, sf_dir)[2]


@query(f"""{_ROWS}, form AS (SELECT key, trim(regexp_replace(lower(name), '[^0-9a-z]+', ' ', 'g')) AS n, min((f, r, name)) AS first FROM p GROUP BY 1, 2), longest AS (SELECT key, arg_min(first[3], (-length(first[3]), first)) AS name FROM form GROUP BY 1),
sizes AS (SELECT key, arg_min(size, (f, r)) AS size, count(DISTINCT size) AS n FROM p GROUP BY 1), tail AS (SELECT key, count(*) AS rows, count(DISTINCT f) AS files FROM p GROUP BY 1)
SELECT id, longest.name AS label, CAST(sizes.size AS VARCHAR) AS size, tail.rows AS source_rows, tail.files AS source_files, CASE WHEN n > 1 THEN 1 ELSE 0 END::BIGINT AS conflict_count, 100.0::DOUBLE AS completeness, CASE WHEN n > 1 THEN 'CONFLICT_PRESERVED' WHEN tail.rows > 1 THEN 'MERGED' ELSE 'CANONICAL' END AS disposition
FROM ids JOIN longest USING (key) JOIN sizes USING (key) JOIN tail USING (key) WHERE entity = 'PRODUCT'""")
def canonical_products(spark, sf_dir):
    found = canonical.masters(*_build(spark, sf_dir), MODEL).where("entity = 'PRODUCT'")
    return found.select("id", "label", F.col("fields")["size"].alias("size"), "source_rows", "source_files", "conflict_count", "completeness", "disposition")


@query(f"""{_ROWS} SELECT entity, id, CASE entity WHEN 'BRAND' THEN (SELECT arg_min(value, (f, r, value)) FROM refs WHERE to_entity = 'BRAND' AND to_key = ids.key) WHEN 'SUPPLIER' THEN (SELECT max(name) FROM s WHERE s.key = ids.key) ELSE '' END AS label,
 CASE entity WHEN 'SUPPLIER' THEN 1 ELSE 0 END::BIGINT AS source_rows, CASE entity WHEN 'COUNTRY' THEN 0.0 ELSE 100.0 END::DOUBLE AS completeness, 'CANONICAL' AS disposition FROM ids WHERE entity <> 'PRODUCT'""")
def canonical_others(spark, sf_dir):
    return canonical.masters(*_build(spark, sf_dir), MODEL).where("entity <> 'PRODUCT'").select("entity", "id", "label", "source_rows", "completeness", "disposition")


@query(f"{_ROWS} SELECT relation, a.id AS source_id, b.id AS target_id, count(*) AS evidence FROM refs JOIN ids a ON a.entity = refs.entity AND a.key = refs.key JOIN ids b ON b.entity = to_entity AND b.key = to_key GROUP BY 1, 2, 3")
def canonical_edges(spark, sf_dir):
    _, refs, ids = _build(spark, sf_dir)
    return canonical.edges(refs, ids)


@query(f"{_ROWS}, f AS (SELECT entity, key, relation, to_entity, arg_min(to_key, (f, r, to_key)) AS to_key FROM refs GROUP BY 1, 2, 3, 4) SELECT f.entity, f.key, relation, id AS target_id FROM f JOIN ids ON ids.entity = to_entity AND ids.key = to_key")
def first_references(spark, sf_dir):
    _, refs, ids = _build(spark, sf_dir)
    return canonical.first_references(refs, ids)


@query(f"""{_ROWS}, c AS (SELECT 'PRODUCT' AS entity, key, f, r, unnest(['name', 'size', 'brand', 'type']) AS target, unnest([name, CAST(size AS VARCHAR), brand, type]) AS value FROM p UNION ALL SELECT 'SUPPLIER', key, f, r, unnest(['name', 'country', 'balance']), unnest([name, country, CAST(balance AS VARCHAR)]) FROM s)
SELECT id, target, f AS file_id, r AS row_no, value, 'ROW' AS kind FROM c JOIN ids USING (entity, key) WHERE value IS NOT NULL UNION ALL SELECT id, relation, f, r, value, 'REFERENCE' FROM refs JOIN ids ON ids.entity = to_entity AND ids.key = to_key WHERE NOT direct""")
def canonical_sources(spark, sf_dir):
    return canonical.source_cells(*_build(spark, sf_dir))
