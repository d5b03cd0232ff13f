"""Conflicts of a table against a changed copy of itself, and verdicts on pairs of datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import compare, conflicts
from lumenfold.plans.comparing import _TOK
from lumenfold.plans.registry import load, query

_JACCARD = "CASE WHEN len(list_distinct(list_concat(tx, ty))) = 0 THEN 0 ELSE round(len(list_intersect(tx, ty)) / len(list_distinct(list_concat(tx, ty))), 4) END"

#: A pair of values, what the field is, which side is newer, and what its two columns mean; by the part's number.
_CASES = """SELECT p_partkey AS id,
 CASE p_partkey % 13 WHEN 6 THEN p_type WHEN 7 THEN '2024-01-0' || CAST(1 + p_partkey % 9 AS VARCHAR) WHEN 8 THEN CAST(p_size AS VARCHAR) WHEN 11 THEN 'n/a' ELSE p_name END AS value_a,
 CASE p_partkey % 13 WHEN 0 THEN upper(p_name) || '.' WHEN 1 THEN NULL WHEN 2 THEN 'tbd' WHEN 3 THEN 'None' WHEN 4 THEN p_name || ' xl' WHEN 5 THEN 'zzz' WHEN 6 THEN p_type || ' WITHDRAWN'
  WHEN 7 THEN '2024-02-11' WHEN 8 THEN CAST(p_size + 1 AS VARCHAR) WHEN 9 THEN 'other words' WHEN 10 THEN 'a brand' WHEN 11 THEN p_name ELSE p_name || ' xl' END AS value_b,
 CASE p_partkey % 13 WHEN 6 THEN 'STATUS' WHEN 7 THEN 'EFFECTIVE_DATE' WHEN 8 THEN 'NUMERIC_OR_COUNT' ELSE 'TITLE' END AS kind,
 CASE p_partkey % 13 WHEN 5 THEN 'B' WHEN 12 THEN 'A' ELSE '' END AS newer, 'left' AS field_a, CASE p_partkey % 13 WHEN 10 THEN 'right' ELSE 'left' END AS field_b FROM part"""
_RULED = f"""WITH c AS ({_CASES}),
f AS (SELECT *, trim(regexp_replace(lower(coalesce(value_a, '')), '[^0-9a-z]+', ' ', 'g')) AS na, trim(regexp_replace(lower(coalesce(value_b, '')), '[^0-9a-z]+', ' ', 'g')) AS nb FROM c),
r AS (SELECT *, CASE WHEN na = nb THEN 'SAME_VALUE_DIFFERENT_FORMAT' WHEN coalesce(value_a, '') = '' OR coalesce(value_b, '') = '' THEN 'ONE_SIDE_NULL'
 WHEN lower(value_a) IN ('none', 'nil', 'no') OR lower(value_b) IN ('none', 'nil', 'no') THEN 'ASSERTED_ABSENCE_VS_VALUE'
 WHEN lower(value_a) IN ('tbd', 'n/a') OR lower(value_b) IN ('tbd', 'n/a') THEN 'ONE_SIDE_PLACEHOLDER'
 WHEN kind NOT IN ('STATUS', 'EFFECTIVE_DATE') AND (contains(na, nb) OR contains(nb, na)) THEN 'SUBSTRING_ENRICHMENT'
 WHEN newer <> '' THEN 'VERSION_EVIDENCE' WHEN kind = 'STATUS' THEN 'STATUS_DISAGREEMENT' WHEN kind = 'EFFECTIVE_DATE' THEN 'DATE_DISAGREEMENT' WHEN kind = 'NUMERIC_OR_COUNT' THEN 'NUMERIC_DISAGREEMENT' ELSE 'FREE_TEXT_DIVERGENCE' END AS first_rule FROM f)"""
_JUDGED = """j AS (SELECT *, CASE rule WHEN 'ASSERTED_ABSENCE_VS_VALUE' THEN 'REQUIRES_REVIEW' WHEN 'STATUS_DISAGREEMENT' THEN 'UNRESOLVED_PRESERVE_BOTH' WHEN 'DATE_DISAGREEMENT' THEN 'UNRESOLVED_PRESERVE_BOTH' WHEN 'NUMERIC_DISAGREEMENT' THEN 'UNRESOLVED_PRESERVE_BOTH' WHEN 'FREE_TEXT_DIVERGENCE' THEN 'UNRESOLVED_PRESERVE_BOTH' ELSE 'RESOLVED' END AS status,
 CASE rule WHEN 'SAME_VALUE_DIFFERENT_FORMAT' THEN 1.0 WHEN 'ONE_SIDE_NULL' THEN 0.95 WHEN 'ONE_SIDE_PLACEHOLDER' THEN 0.9 WHEN 'SUBSTRING_ENRICHMENT' THEN 0.8 WHEN 'VERSION_EVIDENCE' THEN 0.85 WHEN 'HOMONYM_NOT_A_CONFLICT' THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence,
 CASE WHEN rule IN ('SAME_VALUE_DIFFERENT_FORMAT', 'SUBSTRING_ENRICHMENT') THEN (CASE WHEN length(value_b) > length(value_a) THEN value_b ELSE value_a END) WHEN rule = 'ONE_SIDE_NULL' THEN coalesce(value_a, value_b)
  WHEN rule = 'ONE_SIDE_PLACEHOLDER' THEN (CASE WHEN lower(value_a) IN ('tbd', 'n/a') THEN value_b ELSE value_a END) WHEN rule = 'VERSION_EVIDENCE' THEN (CASE newer WHEN 'A' THEN value_a ELSE value_b END) ELSE '' END AS winner FROM q)"""


def _cases(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    k, name = F.col("p_partkey") % 13, F.col("p_name")
    a = F.when(k == 6, F.col("p_type")).when(k == 7, F.concat(F.lit("2024-01-0"), (1 + F.col("p_partkey") % 9).cast("string"))).when(k == 8, F.col("p_size").cast("string")).when(k == 11, "n/a").otherwise(name)
    b = F.when(k == 0, F.concat(F.upper(name), F.lit("."))).when(k == 1, F.lit(None)).when(k == 2, "tbd").when(k == 3, "None").when(k == 5, "zzz").when(k == 6, F.concat("p_type", F.lit(" WITHDRAWN")))
    b = b.when(k == 7, "2024-02-11").when(k == 8, (F.col("p_size") + 1).cast("string")).when(k == 9, "other words").when(k == 10, "a brand").when(k == 11, name).otherwise(F.concat(name, F.lit(" xl")))
    kind = F.when(k == 6, "STATUS").when(k == 7, "EFFECTIVE_DATE").when(k == 8, "NUMERIC_OR_COUNT").otherwise("TITLE")
    newer = F.when(k == 5, "B").when(k == 12, "A").otherwise("")
    return part.select(F.col("p_partkey").alias("id"), a.alias("value_a"), b.alias("value_b"), kind.alias("kind"), newer.alias("newer"), F.lit("left").alias("field_a"), F.when(k == 10, "right").otherwise("left").alias("field_b"))


@query(f"{_RULED}, q AS (SELECT *, first_rule AS rule FROM r), {_JUDGED} SELECT id, rule, status, confidence, winner FROM j")
def conflict_policy(spark, sf_dir):
    ruled = conflicts.with_policy(conflicts.with_conflict_rule(_cases(spark, sf_dir), "value_a", "value_b", F.col("kind"), F.col("newer")))
    return ruled.select("id", "rule", "status", "confidence", conflicts.winner(F.col("value_a"), F.col("value_b"), F.col("newer")).alias("winner"))


@query(f"{_RULED}, q AS (SELECT *, CASE WHEN field_a <> field_b THEN 'HOMONYM_NOT_A_CONFLICT' ELSE first_rule END AS rule FROM r), {_JUDGED} SELECT id, rule, status, confidence, winner FROM j")
def readjudicated(spark, sf_dir):
    meanings = spark.createDataFrame([("left", "title"), ("right", "brand")], "column string, target string")
    return conflicts.readjudicate(_cases(spark, sf_dir), meanings, F.col("kind"), F.col("newer")).select("id", "rule", "status", "confidence", "winner")


#: Parts against a copy in which names are written otherwise or extended, brands are blank or placeholders, some rows are gone and some are new.
_COPY = """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN upper(p_name) || ' ' WHEN p_partkey % 5 = 0 THEN p_name || ' Ltd' ELSE p_name END AS p_name,
 CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 11 = 1 THEN 'n/a' WHEN p_partkey % 11 = 2 THEN p_brand || ' &amp; co' ELSE p_brand END AS p_brand, p_type, p_size FROM part WHERE p_partkey % 13 <> 0
 UNION ALL SELECT p_partkey + 10000000, p_name, p_brand, p_type, p_size FROM part WHERE p_partkey % 17 = 0"""
_OWN = "SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part"
_NORM = "lower(trim(regexp_replace(coalesce(CAST({c} AS VARCHAR), ''), '\\s+', ' ', 'g')))"


def _parts(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


def _copy(a):
    k = F.col("p_partkey")
    name = F.when(k % 7 == 0, F.concat(F.upper("p_name"), F.lit(" "))).when(k % 5 == 0, F.concat("p_name", F.lit(" Ltd"))).otherwise(F.col("p_name"))
    brand = F.when(k % 11 == 0, F.lit(None)).when(k % 11 == 1, "n/a").when(k % 11 == 2, F.concat("p_brand", F.lit(" &amp; co"))).otherwise(F.col("p_brand"))
    changed = a.where(k % 13 != 0).select("p_partkey", name.alias("p_name"), brand.alias("p_brand"), "p_type", "p_size")
    return changed.unionByName(a.where(k % 17 == 0).withColumn("p_partkey", k + 10000000))


def _same(c):
    return f"CASE WHEN {_NORM.format(c=c)} = 'n/a' THEN '' ELSE {_NORM.format(c=c)} END"


@query(f"""WITH a AS ({_OWN}), b AS ({_COPY}), u AS (SELECT a.p_partkey AS k, 'p_name' AS col, a.p_name AS x, b.p_name AS y FROM a JOIN b USING (p_partkey) UNION ALL SELECT a.p_partkey, 'p_brand', a.p_brand, b.p_brand FROM a JOIN b USING (p_partkey)),
d AS (SELECT *, (y IS NULL OR y = 'n/a') AS gone, contains(y, '&amp;') AS my FROM u WHERE x IS DISTINCT FROM y),
w AS (SELECT *, {_TOK.format(c="coalesce(x, '')")} AS tx, {_TOK.format(c="coalesce(y, '')")} AS ty FROM d)
SELECT col AS "column", count(*) AS n, count(DISTINCT k) AS keys, 0::BIGINT AS a_blank, count(*) FILTER (gone) AS b_blank, 0::BIGINT AS a_artefacts, count(*) FILTER (my) AS b_artefacts, count(*) FILTER (NOT gone) AS both_real,
 count(*) FILTER ({_same('x')} = {_same('y')}) AS format_variants, round(avg(floor((length(x) + length(coalesce(y, ''))) / 2)), 4) AS mean_length, round(avg({_JACCARD}), 4) AS mean_token_jaccard FROM w GROUP BY col""")
def conflict_shape(spark, sf_dir):
    a = _parts(spark, sf_dir)
    met = compare.matched_cells(a, _copy(a), "p_partkey", ["p_name", "p_brand"])
    return compare.conflict_shape(met.where(~F.col("value_a").eqNullSafe(F.col("value_b"))), ["column"])


@query(f"""WITH a AS ({_OWN}), b AS ({_COPY}), ra AS (SELECT p_partkey, {_same('p_name')} AS n, {_same('p_brand')} AS d, p_type, p_size, count(*) AS c FROM a GROUP BY ALL), rb AS (SELECT p_partkey, {_same('p_name')} AS n, {_same('p_brand')} AS d, p_type, p_size, count(*) AS c FROM b GROUP BY ALL),
j AS (SELECT coalesce(ra.c, 0) AS x, coalesce(rb.c, 0) AS y FROM ra FULL JOIN rb USING (p_partkey, n, d, p_type, p_size)),
r AS (SELECT sum(x)::BIGINT AS rows_a, sum(y)::BIGINT AS rows_b, sum(least(x, y))::BIGINT AS common_rows FROM j),
k AS (SELECT count(*) FILTER (a.p_partkey = b.p_partkey) AS common_keys, count(*) FILTER (b.p_partkey IS NULL) AS only_a_keys, count(*) FILTER (a.p_partkey IS NULL) AS only_b_keys FROM (SELECT DISTINCT p_partkey FROM a) a FULL JOIN (SELECT DISTINCT p_partkey FROM b) b ON a.p_partkey = b.p_partkey),
e AS (SELECT count(*) FILTER (a.n = b.n) / count(*) AS ej FROM (SELECT DISTINCT {_same('p_name')} AS n FROM a) a FULL JOIN (SELECT DISTINCT {_same('p_name')} AS n FROM b) b ON a.n = b.n)
SELECT rows_a, rows_b, common_rows, 5 AS common_columns, 1.0::DOUBLE AS column_jaccard, true AS reliable, round(common_rows / (rows_a + rows_b - common_rows), 4) AS row_jaccard, round(0.65 * round(common_rows / (rows_a + rows_b - common_rows), 4) + 0.35, 4) AS similarity, common_keys, only_a_keys, only_b_keys, round(common_keys / (common_keys + only_a_keys + only_b_keys), 4) AS key_jaccard, round(ej, 4) AS entity_jaccard, CASE WHEN common_keys > 0 THEN 'KEY_LINKED' ELSE 'OTHER' END AS identity FROM r, k, e""")
def deep_pair(spark, sf_dir):
    a = _parts(spark, sf_dir)
    return compare.deep_pair(a, _copy(a), "p_partkey", ["p_name"])


#: Facts of pairs, made of customers' numbers so that every step of the cascade is met.
_FACTS = """SELECT c_custkey AS pair, c_custkey % 23 = 0 AS same_bytes, c_custkey % 19 = 0 AS same_rows, c_custkey % 3 > 0 AS same_attributes, CASE WHEN c_custkey % 11 = 0 THEN 2 ELSE 0 END AS discriminators, (c_custkey % 4) * (c_custkey % 2) AS conflicts,
 CASE c_custkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE '' END AS newer, c_custkey % 9 * 10 - (CASE WHEN c_custkey % 18 = 0 THEN 1 ELSE 0 END) AS common_keys, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE c_custkey % 13 END AS only_a, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE c_custkey % 7 * 9 END AS only_b, (c_custkey % 21) / 20.0 AS entity_jaccard, 100 + c_custkey % 10 AS rows_a, 90 AS rows_b FROM customer"""


@query(f"""WITH f AS ({_FACTS}), g AS (SELECT *, CASE WHEN common_keys > 0 THEN round(common_keys / (common_keys + only_a + only_b), 4) ELSE 0 END AS kj, CASE WHEN common_keys > 0 THEN 'KEY_LINKED' WHEN entity_jaccard >= 0.3 THEN 'SAME_ENTITIES_DIFFERENT_KEY_NAMESPACE' ELSE 'NONE' END AS identity, common_keys + only_a + only_b AS every FROM f),
h AS (SELECT *, kj >= 0.95 AND only_a = 0 AND only_b = 0 AS whole FROM g),
s AS (SELECT *, CASE WHEN same_bytes THEN 1 WHEN same_rows THEN 2 WHEN whole AND discriminators > 0 THEN 3 WHEN whole AND same_attributes AND conflicts > 0 AND newer <> '' THEN 4 WHEN whole AND same_attributes AND conflicts > 0 THEN 5 WHEN whole AND same_attributes THEN 6 WHEN whole THEN 7
 WHEN common_keys > 0 AND same_attributes AND kj >= 0.3 THEN 8 WHEN common_keys > 0 THEN 9 WHEN identity = 'SAME_ENTITIES_DIFFERENT_KEY_NAMESPACE' THEN 10 WHEN entity_jaccard < 0.05 THEN 11 ELSE 12 END AS step FROM h)
SELECT pair, CASE step WHEN 1 THEN 'EXACT_DUPLICATE' WHEN 2 THEN 'IDENTICAL_CONTENT' WHEN 3 THEN 'DIFFERENT_ENTITY' WHEN 4 THEN (CASE newer WHEN 'B' THEN 'VERSION_NEWER' ELSE 'VERSION_OLDER' END) WHEN 5 THEN 'CONFLICTING' WHEN 6 THEN 'LIKELY_DUPLICATE' WHEN 8 THEN 'DUPLICATE_WITH_UNIQUE_DATA'
  WHEN 10 THEN (CASE WHEN entity_jaccard >= 0.6 AND same_attributes THEN 'LIKELY_DUPLICATE' ELSE 'COMPLEMENTARY' END) WHEN 11 THEN 'DIFFERENT_ENTITY' WHEN 12 THEN 'REQUIRES_REVIEW' ELSE 'COMPLEMENTARY' END AS decision,
 CASE WHEN step = 1 THEN 1 WHEN step = 2 THEN 2 WHEN step IN (3, 11) THEN 3 ELSE 4 END AS level,
 CASE WHEN step IN (1, 2, 6) THEN 'A' WHEN step IN (3, 11) THEN 'BOTH_KEEP_SEPARATE' WHEN step = 4 THEN newer WHEN step = 5 THEN 'BOTH_PRESERVE_CONFLICTS' WHEN step IN (7, 8, 9) THEN 'MERGE_UNION' WHEN step = 10 THEN 'MERGE_AFTER_REKEY' ELSE 'UNDECIDED_REVIEW_REQUIRED' END AS canonical,
 CASE WHEN step = 3 THEN 2 * common_keys WHEN step IN (6, 7) THEN common_keys WHEN step IN (8, 9) THEN every WHEN step = 10 THEN rows_a + rows_b ELSE 0 END::BIGINT AS merged, CASE WHEN step IN (1, 2) THEN rows_b ELSE 0 END::BIGINT AS archived,
 CASE WHEN step IN (3, 5, 6, 7, 10, 12) THEN true WHEN step = 8 THEN conflicts > 0 WHEN step = 9 THEN NOT same_attributes OR conflicts > 0 ELSE false END AS review FROM s""")
def pair_verdicts(spark, sf_dir):
    k = F.col("c_custkey")
    facts = load(spark, sf_dir, "customer").select(
        k.alias("pair"), (k % 23 == 0).alias("same_bytes"), (k % 19 == 0).alias("same_rows"), (k % 3 > 0).alias("same_attributes"), F.when(k % 11 == 0, 2).otherwise(0).alias("discriminators"), ((k % 4) * (k % 2)).alias("conflicts"),
        F.when(k % 5 == 0, "A").when(k % 5 == 1, "B").otherwise("").alias("newer"), (k % 9 * 10 - (k % 18 == 0).cast("int")).alias("common_keys"), F.when(k % 2 == 0, 0).otherwise(k % 13).alias("only_a"), F.when(k % 2 == 0, 0).otherwise(k % 7 * 9).alias("only_b"), ((k % 21) / 20).alias("entity_jaccard"), (100 + k % 10).alias("rows_a"), F.lit(90).alias("rows_b"),
    )
    linked = F.col("common_keys") > 0
    facts = facts.withColumns({"key_jaccard": F.when(linked, F.round(F.col("common_keys") / (F.col("common_keys") + F.col("only_a") + F.col("only_b")), 4)).otherwise(0.0), "identity": F.when(linked, "KEY_LINKED").when(F.col("entity_jaccard") >= 0.3, "SAME_ENTITIES_DIFFERENT_KEY_NAMESPACE").otherwise("NONE")})
    return facts.select("pair", compare.pair_verdict({c: F.col(c) for c in facts.columns}).alias("v")).select("pair", "v.*")


@query("""WITH s AS (SELECT o_custkey % 50 AS pair, count(*) AS n, count(*) FILTER (o_totalprice > 250000) AS a, count(*) FILTER (o_totalprice < 20000 AND o_custkey % 2 = 0) AS b, count(*) FILTER (o_orderstatus = 'P' AND o_custkey % 3 = 0) AS c, count(*) FILTER (o_orderpriority = '1-URGENT' AND o_custkey % 4 > 0) AS d FROM orders GROUP BY 1)
SELECT pair, CASE WHEN b = 0 AND a >= 0.3 * n THEN 'B' WHEN a = 0 AND b >= 0.3 * n THEN 'A' WHEN d = 0 AND c > 0 THEN 'B' WHEN c = 0 AND d > 0 THEN 'A' ELSE '' END AS newer, CASE WHEN (b = 0 AND a >= 0.3 * n) OR (a = 0 AND b >= 0.3 * n) THEN 'ENRICHMENT' WHEN (d = 0 AND c > 0) OR (c = 0 AND d > 0) THEN 'REPAIR' ELSE 'INCONCLUSIVE' END AS evidence FROM s""")
def version_direction(spark, sf_dir):
    price, key = F.col("o_totalprice"), F.col("o_custkey")
    counts = load(spark, sf_dir, "orders").groupBy((key % 50).alias("pair")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(price > 250000, 1)).alias("a"), F.count(F.when((price < 20000) & (key % 2 == 0), 1)).alias("b"), F.count(F.when((F.col("o_orderstatus") == "P") & (key % 3 == 0), 1)).alias("c"), F.count(F.when((F.col("o_orderpriority") == "1-URGENT") & (key % 4 > 0), 1)).alias("d"))
    return counts.select("pair", compare.version_direction(F.col("n"), F.col("a"), F.col("b"), F.col("c"), F.col("d"), 0.3).alias("v")).select("pair", "v.*")


_SHAPES = "SELECT l_suppkey AS pair, CASE l_linenumber % 4 WHEN 0 THEN 'scheme_id' WHEN 1 THEN 'remarks' WHEN 2 THEN 'lab_name' ELSE 'scope' END AS col, count(*) AS n, count(DISTINCT l_orderkey) AS keys, count(*) FILTER (l_returnflag <> 'R') AS both_real, count(*) FILTER (l_discount > 0.09 AND l_suppkey % 2 = 0) AS format_variants, round(avg(l_quantity) + 16, 4) AS mean_length, round(avg(l_tax) * 5, 4) AS mean_token_jaccard FROM lineitem GROUP BY 1, 2"


def _shapes(spark, sf_dir):
    col = F.col("l_linenumber") % 4
    named = load(spark, sf_dir, "lineitem").withColumn("column", F.when(col == 0, "scheme_id").when(col == 1, "remarks").when(col == 2, "lab_name").otherwise("scope"))
    return named.groupBy(F.col("l_suppkey").alias("pair"), "column").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("keys"), F.count(F.when(F.col("l_returnflag") != "R", 1)).alias("both_real"), F.count(F.when((F.col("l_discount") > 0.09) & (F.col("l_suppkey") % 2 == 0), 1)).alias("format_variants"), F.round(F.avg("l_quantity") + 16, 4).alias("mean_length"), F.round(F.avg("l_tax") * 5, 4).alias("mean_token_jaccard"))


#: Two notes on each part: in some brands on different matters, in others in the same words, with cells alike, or short.
_NOTES = """SELECT p_brand AS pair, CAST(p_partkey AS VARCHAR) AS key, 'notes' AS col, 'kept dry in the northern depot since its ' || lower(p_type) || ' batch of ' || p_size AS x,
 CASE WHEN p_size % 2 = 0 AND substring(p_brand, 7) IN ('2', '7') THEN 'kept dry in the northern depot since its ' || lower(p_type) || ' batch of ' || p_size WHEN substring(p_brand, 7) IN ('3', '8') THEN 'kept dry in the southern depot since its batch of ' || p_size ELSE 'invoices go through ' || p_name || ' brokers whenever customs duties rise' END AS y FROM part
 UNION ALL SELECT p_brand, CAST(p_partkey AS VARCHAR), 'code', p_type, p_name FROM part"""


@query(f"""WITH n AS ({_NOTES}), m AS (SELECT pair, count(*) AS matched FROM part JOIN (SELECT DISTINCT pair FROM n) ON pair = p_brand GROUP BY 1), w AS (SELECT *, {_TOK.format(c='x')} AS tx, {_TOK.format(c='y')} AS ty FROM n WHERE x <> y),
s AS (SELECT pair, col, count(*) AS n, count(DISTINCT key) AS keys, avg(floor((length(x) + length(y)) / 2)) AS l, avg({_JACCARD}) AS j FROM w GROUP BY 1, 2) SELECT pair, col AS "column" FROM s JOIN m USING (pair) WHERE keys >= 0.95 * matched AND l >= 40 AND round(j, 4) < 0.2""")
def homonyms(spark, sf_dir):
    """Columns of one name whose cells, taken key by key, are about different things."""
    part, mark = load(spark, sf_dir, "part"), F.substring("p_brand", 7, 9)
    same = F.concat(F.lit("kept dry in the northern depot since its "), F.lower("p_type"), F.lit(" batch of "), "p_size")
    other = F.concat(F.lit("invoices go through "), "p_name", F.lit(" brokers whenever customs duties rise"))
    notes = F.when((F.col("p_size") % 2 == 0) & mark.isin("2", "7"), same).when(mark.isin("3", "8"), F.concat(F.lit("kept dry in the southern depot since its batch of "), "p_size")).otherwise(other)
    cells = lambda c, a, b: part.select(F.col("p_brand").alias("pair"), F.col("p_partkey").cast("string").alias("key"), F.lit(c).alias("column"), a.alias("value_a"), b.alias("value_b"))
    met = cells("notes", same, notes).unionByName(cells("code", F.col("p_type"), F.col("p_name")))
    shapes = compare.conflict_shape(met.where("value_a <> value_b"), ["pair", "column"])
    matched = part.groupBy(F.col("p_brand").alias("pair")).agg(F.count("*").alias("matched"))
    return compare.homonyms(shapes.join(matched, "pair"), F.col("matched")).select("pair", "column")


@query(f"SELECT pair, col AS \"column\" FROM ({_SHAPES}) WHERE col IN ('scheme_id', 'lab_name') AND keys >= 0.99 * 40")
def discriminators(spark, sf_dir):
    return compare.discriminators(_shapes(spark, sf_dir), F.lit(40)).select("pair", "column")


@query("""WITH f AS (SELECT c_custkey AS pair, CASE c_custkey % 6 WHEN 0 THEN 'IDENTICAL' WHEN 1 THEN 'SUBSET' WHEN 2 THEN 'SUBSTANTIAL' WHEN 3 THEN 'OVERLAP' WHEN 4 THEN 'WEAK' ELSE 'DISJOINT' END AS v, (c_custkey % 10) / 10.0 AS j, c_custkey % 8 AS common, c_custkey % 12 AS a, 5 + c_custkey % 7 AS b FROM customer)
SELECT pair, a > 0 AND b > 0 AND (v IN ('IDENTICAL', 'SUBSET', 'SUBSTANTIAL') OR j >= 0.6 OR common >= 0.6 * least(a, b)) AS same FROM f""")
def same_attributes(spark, sf_dir):
    k = F.col("c_custkey")
    verdict = F.element_at(F.array(*map(F.lit, ["IDENTICAL", "SUBSET", "SUBSTANTIAL", "OVERLAP", "WEAK", "DISJOINT"])), (k % 6 + 1).cast("int"))
    return load(spark, sf_dir, "customer").select(k.alias("pair"), compare.same_attributes(verdict, (k % 10) / 10, k % 8, k % 12, 5 + k % 7).alias("same"))
