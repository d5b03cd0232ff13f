"""Retrieval queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lumenfold.operators import retrieve
from lumenfold.plans.registry import load, query

#: A fixed query vector of 64 numbers.
VECTOR = [((i * 37) % 17 - 8) / 8 for i in range(64)]
_V = "[" + ", ".join(map(str, VECTOR)) + "]::DOUBLE[]"
_EXACT = f"round(list_cosine_similarity(embedding::DOUBLE[], {_V}), 12)"
_SCORE = f"round(list_cosine_similarity(embedding::DOUBLE[], {_V}), 6)"


@query("""SELECT r_name, n_name, c_mktsegment FROM (SELECT DISTINCT r_name, n_name, c_mktsegment FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey)""")
def relationship_lookup(spark, sf_dir):
    r, n, c = (load(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    return retrieve.traverse(r, n, c, "r_regionkey", "n_regionkey", "n_nationkey", "c_nationkey", ["r_name", "n_name", "c_mktsegment"])


@query("SELECT a.n_nationkey, a.n_name, b.n_name AS related_name FROM nation a LEFT JOIN nation b ON b.n_nationkey = a.n_nationkey + 5 AND b.n_regionkey = a.n_regionkey")
def related_left(spark, sf_dir):
    a = load(spark, sf_dir, "nation")
    b = a.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("related_name"), F.col("n_regionkey").alias("r"))
    return a.join(b, (F.col("k") == F.col("n_nationkey") + 5) & (F.col("r") == F.col("n_regionkey")), "left").select("n_nationkey", "n_name", "related_name")


_WORDS = ["steel", "small", "brushed"]


@query(f"""WITH s AS (SELECT p_partkey, p_type, {' + '.join(f"(contains(lower(p_name || ' ' || p_type), '{w}'))::INT" for w in _WORDS)} AS score FROM part),
t AS (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 20) SELECT p_partkey, p_type, score FROM t WHERE score = 3 OR (SELECT max(score) FROM t) < 3""")
def keyword_search(spark, sf_dir):
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return retrieve.keyword_search(part, ["p_name", "p_type"], "which small brushed steel", "p_partkey", 20).select("p_partkey", "p_type", "score")


@query(f"SELECT vec_id, label, {_SCORE} AS score FROM embeddings ORDER BY {_EXACT} DESC, vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    return retrieve.vector_topk(load(spark, sf_dir, "embeddings"), VECTOR, "embedding", "vec_id", 10).select("vec_id", "label", "score")


@query(f"SELECT vec_id, label, {_SCORE} AS score FROM embeddings WHERE label IN (1, 2, 3) ORDER BY {_EXACT} DESC, vec_id LIMIT 10")
def filtered_topk(spark, sf_dir):
    df = load(spark, sf_dir, "embeddings")
    return retrieve.vector_topk(df, VECTOR, "embedding", "vec_id", 10, F.col("label").isin(1, 2, 3)).select("vec_id", "label", "score")


_OWN_VECTOR = "list_transform(range(64), lambda j: ((j * 37 + label * 5) % 17 - 8) / 8.0)::DOUBLE[]"


@query(f"SELECT vec_id, label, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY exact DESC, vec_id)::INT AS rank FROM (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], {_OWN_VECTOR}), 12) AS exact, round(list_cosine_similarity(embedding::DOUBLE[], {_OWN_VECTOR}), 6) AS score FROM embeddings)) WHERE rank <= 3")
def focused_topk(spark, sf_dir):
    df = load(spark, sf_dir, "embeddings")
    vector = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: (F.pmod(j * 37 + F.col("label") * 5, F.lit(17)) - 8) / 8.0)
    return retrieve.focused_topk(df, df.select("label").distinct().withColumn("query", vector), "embedding", "vec_id", "label", 3).select("vec_id", "label", "score", "rank")


_HYBRID = f"""WITH a AS (SELECT vec_id, label, 1.0::DOUBLE AS score, 0 AS sr FROM embeddings WHERE label = 2 ORDER BY vec_id LIMIT 5), b AS (SELECT vec_id, label, {_SCORE} AS score, 1 AS sr FROM embeddings ORDER BY {_EXACT} DESC, vec_id LIMIT 10),
u AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sr, score DESC) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b)), h AS (SELECT * FROM u WHERE n = 1)"""


def _hybrid(spark, sf_dir):
    df = load(spark, sf_dir, "embeddings")
    first = df.where("label = 2").select("vec_id", "label", F.lit(1.0).alias("score"))
    second = retrieve.vector_topk(df, VECTOR, "embedding", "vec_id", 10).select("vec_id", "label", "score")
    return retrieve.hybrid([(first, 5), (second, 10)], "vec_id")


@query(f"{_HYBRID} SELECT vec_id, label, score, sr AS source_rank FROM h")
def hybrid_merge(spark, sf_dir):
    return _hybrid(spark, sf_dir)


@query(f"""{_HYBRID}, x AS (SELECT h.vec_id, h.score, d.lang, d.source, d.text, l.quality FROM h JOIN documents d ON d.doc_id = h.vec_id LEFT JOIN labels l ON l.doc_id = d.doc_id),
r AS (SELECT vec_id, length(text) AS len, round(least(score + (CASE WHEN source = 'src1' THEN 0.35 ELSE 0 END) + (CASE lang WHEN 'en' THEN 0.30 WHEN 'de' THEN 0.12 ELSE 0 END) + (CASE WHEN contains(lower(source), 'src') THEN 0.04 ELSE 0 END) + 0.01 + (CASE WHEN quality IS NOT NULL THEN 0.02 ELSE 0 END) - (CASE WHEN length(text) < 60 THEN 0.02 ELSE 0 END), 1.0), 4) AS relevance FROM x)
SELECT vec_id AS chunk_id, relevance FROM r ORDER BY relevance DESC, len DESC, vec_id LIMIT 6""")
def hybrid_rerank(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l_id")
    found = _hybrid(spark, sf_dir).join(docs, F.col("vec_id") == F.col("doc_id")).join(labels, F.col("l_id") == F.col("doc_id"), "left")
    none = F.lit(None).cast("string")
    rows = found.select(
        F.col("vec_id").alias("chunk_id"), "score", F.when(F.col("source") == "src1", "1").alias("number"), F.when(F.col("lang") == "en", "IS_STANDARD").when(F.col("lang") == "de", "DOCUMENT").alias("document_type"),
        F.col("source").alias("title"), none.alias("clause"), F.lit(1).alias("page"), F.col("quality").cast("string").alias("version"), none.alias("effective_date"), none.alias("source_url"), F.col("text").alias("content"),
    )
    return retrieve.rerank(rows, "src", ["1"]).select("chunk_id", "relevance")


@query("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1")
def facets(spark, sf_dir):
    return retrieve.facets(load(spark, sf_dir, "customer"), "c_mktsegment")


@query("SELECT o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1")
def status_histogram(spark, sf_dir):
    return retrieve.facets(load(spark, sf_dir, "orders"), "o_orderstatus")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_nationkey = 7 AND contains(lower(c_mktsegment), 'b') ORDER BY c_custkey LIMIT 15 OFFSET 3")
def browse(spark, sf_dir):
    return retrieve.browse(load(spark, sf_dir, "customer"), {"c_nationkey": 7}, {"c_mktsegment": "b"}, ["c_custkey"], 15, 3).select("c_custkey", "c_name", "c_mktsegment")


_FIELDS = ["p_name", "p_brand", "p_type", "p_size"]


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS field, CAST(a.{f} AS VARCHAR) AS value_a, CAST(b.{f} AS VARCHAR) AS value_b, coalesce(lower(trim(CAST(a.{f} AS VARCHAR))) = lower(trim(CAST(b.{f} AS VARCHAR))), false) AS same FROM part a, part b WHERE a.p_partkey = 3 AND b.p_partkey = 10" for f in _FIELDS) + ")")
def compare_entities(spark, sf_dir):
    return retrieve.compare_records(load(spark, sf_dir, "part"), "p_partkey", 3, 10, _FIELDS)


@query("WITH a AS (SELECT DISTINCT c_mktsegment AS m FROM customer WHERE c_nationkey = 1), b AS (SELECT DISTINCT c_mktsegment AS m FROM customer WHERE c_nationkey = 2) SELECT coalesce(a.m, b.m) AS member, a.m IS NOT NULL AS in_a, b.m IS NOT NULL AS in_b FROM a FULL JOIN b ON a.m = b.m")
def compare_members(spark, sf_dir):
    return retrieve.compare_members(load(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", 1, 2)


_WANTED = ["5", "1400", "brand#7", "zzz", "999999999999"]


@query("SELECT w AS identifier, CASE WHEN w_found IS NULL THEN 'NOT_VERIFIED' ELSE 'VALIDATED' END AS verdict, w_found AS found_in FROM (SELECT w, CASE WHEN w IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer) THEN 'customer' WHEN w IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders) THEN 'orders' WHEN upper(w) IN (SELECT upper(p_brand) FROM part) THEN 'part' END AS w_found FROM (SELECT unnest([" + ", ".join(f"'{w}'" for w in _WANTED) + "]) AS w))")
def verify_identifier(spark, sf_dir):
    tables = [("customer", load(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment"), ("orders", load(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus"), ("part", load(spark, sf_dir, "part"), "p_brand", "p_type")]
    return reduce(lambda a, b: a.unionByName(b), [retrieve.verify_identifier(tables, w) for w in _WANTED])


@query("SELECT n_regionkey AS r_regionkey, r_name, count(*)::INT AS n_members, string_agg(n_name, ',' ORDER BY n_name) AS members FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2")
def bundles(spark, sf_dir):
    found = retrieve.bundle(load(spark, sf_dir, "region"), "r_regionkey", {"nations": (load(spark, sf_dir, "nation"), "n_regionkey", ["n_name"])})
    return found.select("r_regionkey", "r_name", F.size("nations").alias("n_members"), F.array_join(F.transform("nations", lambda x: x["n_name"]), ",").alias("members"))


@query("""SELECT p_partkey, p_name FROM part WHERE lower(p_name) = (SELECT lower(p_name) FROM part WHERE p_partkey = 1)""")
def exact_lookup(spark, sf_dir):
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    wanted = part.where("p_partkey = 1").first()["p_name"]
    return retrieve.exact_or_prefix(part, "p_name", wanted, "p_partkey")


@query("SELECT l_orderkey AS question, count(*)::INT AS n_evidence, CASE WHEN count(*) FILTER (l_returnflag <> 'N') = 0 THEN 0.0 ELSE round(least(0.35 + 0.5 * max(l_discount) * 10 + 0.05 * greatest(count(*) FILTER (l_returnflag <> 'N') - 1, 0), 0.98), 2) END AS confidence FROM lineitem GROUP BY 1")
def evidence_confidence(spark, sf_dir):
    kept = F.count(F.when(F.col("l_returnflag") != "N", 1))
    found = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("question")).agg(F.count(F.lit(1)).cast("int").alias("n_evidence"), kept.alias("n"), (F.max("l_discount") * 10).alias("top"))
    return found.select("question", "n_evidence", retrieve.evidence_confidence(F.col("top"), F.col("n")).alias("confidence"))


@query("SELECT l_orderkey AS evidence_id, CAST(l_linenumber AS VARCHAR) AS url FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND CAST(l_linenumber AS VARCHAR) NOT IN ('2', '3')")
def invalid_citations(spark, sf_dir):
    cited = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("evidence_id"), F.col("l_linenumber").cast("string").alias("url"))
    known = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("evidence_id"), F.when(F.col("o_orderkey") % 2 == 0, "2").otherwise("3").alias("url"))
    return retrieve.invalid_citations(cited, known).select("evidence_id", "url")


@query(f"""WITH a AS (SELECT doc_id // 3 AS chunk_id, doc_id AS document_id, n_chars, lang, source FROM documents ORDER BY n_chars DESC, chunk_id LIMIT 40), r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY n_chars DESC) AS n FROM a)
SELECT CAST(chunk_id AS VARCHAR) AS evidence_id, coalesce(lang, '') AS lang, n_chars FROM r WHERE n = 1""")
def evidence_set(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 3).alias("chunk_id"), F.col("doc_id").alias("document_id"), "n_chars", "lang")
    return retrieve.evidence_set(docs, 40, "n_chars").select("evidence_id", "lang", "n_chars")


@query("SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 48) ORDER BY p_partkey LIMIT 20")
def membership(spark, sf_dir):
    wanted = load(spark, sf_dir, "lineitem").where("l_quantity > 48").select("l_partkey")
    return retrieve.members_of(load(spark, sf_dir, "part"), "p_partkey", wanted, 20, "p_partkey").select("p_partkey", "p_brand")


@query("""SELECT o_orderkey AS source_id, o_custkey AS target_id, CASE WHEN o_orderkey % 2 = 0 THEN 'CUSTOMER_REF' ELSE 'Part_Ref' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN c_name ELSE p_name END AS label
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN part ON p_partkey = o_custkey WHERE (o_orderkey % 2 = 0 AND c_custkey IS NOT NULL) OR (o_orderkey % 2 = 1 AND p_partkey IS NOT NULL)""")
def typed_edges(spark, sf_dir):
    edges = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id"), F.col("o_custkey").alias("target_id"), F.when(F.col("o_orderkey") % 2 == 0, "CUSTOMER_REF").otherwise("Part_Ref").alias("kind"))
    return retrieve.typed_edges(edges, {"customer": (load(spark, sf_dir, "customer"), "c_custkey", "c_name"), "part": (load(spark, sf_dir, "part"), "p_partkey", "p_name")})
