"""Questions of all customers at once: what they are about, their evidence, and its order."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions.text import SEARCH_STOPWORDS
from lumenfold.operators import batch
from lumenfold.plans.registry import load, query
from lumenfold.storage import written

#: Texts of customers' questions, by their number; a word of each part's name stands for what is asked after.
_TEXTS = [
    "'tests for IS ' || (10000 + k % 900)", "'IS ' || (10000 + k % 500) || ':' || (2000 + k % 3) || ' details'", "'what about it'", "'which ' || name || ' ' || lower(kind)", "'IS 99999 of ' || name", "'zzz and qqq'", "name || ' depot ' || lower(kind)",
]
_SQL_TEXT = "CASE k % 7 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_TEXTS)) + " END"
_ASKED = f"""q AS (SELECT k AS question_id, {_SQL_TEXT} AS text, CASE WHEN k % 2 = 0 THEN 'IS ' || (10000 + k % 700) END AS context, list_transform(range(64), lambda j: ((j * 37 + k * 5) % 17 - 8) / 8.0)::DOUBLE[] AS vector
  FROM (SELECT c_custkey AS k, p_name AS name, p_type AS kind FROM customer JOIN part ON p_partkey = c_custkey % 199)),
standards AS (SELECT p_partkey AS standard_id, 10000 + p_partkey // 4 AS number, (2000 + p_partkey % 4)::INTEGER AS year, p_name || ' depot' AS title FROM part WHERE p_partkey % 2 = 0),
products AS (SELECT p_partkey AS product_id, p_name || ' ' || p_type AS name FROM part WHERE p_partkey % 2 = 1),
edges AS (SELECT DISTINCT l_partkey AS product_id, l_suppkey * 2 AS standard_id FROM lineitem WHERE l_partkey % 2 = 1 AND l_quantity > 40),
chunks AS (SELECT vec_id AS chunk_id, 10000 + label AS number, embedding::DOUBLE[] AS vector, (['IS_STANDARD', 'faq', 'OTHER', NULL])[vec_id % 4 + 1] AS document_type, 'ring note ' || vec_id AS title, CASE WHEN vec_id % 3 = 0 THEN '4.1' END AS clause, vec_id % 5 AS page, CASE WHEN vec_id % 7 = 0 THEN '2' ELSE ' ' END AS version,
  NULL AS effective_date, CASE WHEN vec_id % 2 = 0 THEN 'https://x.gov/' || vec_id END AS source_url, repeat('content ', (vec_id % 20)::INTEGER) AS content FROM embeddings)"""


def _tables(spark, sf_dir):
    part, customer = load(spark, sf_dir, "part"), load(spark, sf_dir, "customer")
    named = part.select(F.col("p_partkey").alias("n"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"))
    base = customer.select(F.col("c_custkey").alias("k")).withColumn("n", F.col("k") % 199).join(F.broadcast(named.where("n < 199")), "n")  # 199 parts at most
    questions = base.select(F.col("k").alias("question_id"), F.expr(_SQL_TEXT).alias("text"), F.expr("CASE WHEN k % 2 = 0 THEN 'IS ' || (10000 + k % 700) END").alias("context"), F.expr("transform(sequence(0, 63), j -> ((j * 37 + k * 5) % 17 - 8) / 8D)").alias("vector"))
    standards = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("standard_id"), F.expr("10000 + p_partkey div 4").alias("number"), F.expr("cast(2000 + p_partkey % 4 as int)").alias("year"), F.concat("p_name", F.lit(" depot")).alias("title"))
    products = part.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("product_id"), F.concat_ws(" ", "p_name", "p_type").alias("name"))
    edges = load(spark, sf_dir, "lineitem").where("l_partkey % 2 = 1 AND l_quantity > 40").select(F.col("l_partkey").alias("product_id"), (F.col("l_suppkey") * 2).alias("standard_id")).distinct()
    v = F.col("vec_id")
    chunks = load(spark, sf_dir, "embeddings").select(
        v.alias("chunk_id"), (10000 + F.col("label")).alias("number"), F.col("embedding").alias("vector"), F.element_at(F.array(F.lit("IS_STANDARD"), F.lit("faq"), F.lit("OTHER"), F.lit(None)), (v % 4 + 1).cast("int")).alias("document_type"), F.concat(F.lit("ring note "), v.cast("string")).alias("title"),
        F.when(v % 3 == 0, "4.1").alias("clause"), (v % 5).alias("page"), F.when(v % 7 == 0, "2").otherwise(" ").alias("version"), F.lit(None).cast("string").alias("effective_date"), F.when(v % 2 == 0, F.concat(F.lit("https://x.gov/"), v.cast("string"))).alias("source_url"), F.repeat(F.lit("content "), (v % 20).cast("int")).alias("content"),
    )
    return written(questions, "questions"), standards, products, edges, chunks


_STOP = "(" + ", ".join(f"'{w}'" for w in SEARCH_STOPWORDS) + ")"
_WORDS = f"list_distinct(list_filter(regexp_extract_all(lower({{c}}), '[a-z0-9]+'), lambda t: length(t) >= 3 AND t NOT IN {_STOP}))"


def _most_words(name: str, table: str, key: str, text: str) -> str:
    """SQL of the rows that hold most words of each question."""
    return f"""{name}_hits AS (SELECT question_id, {key} AS key, len(list_intersect(qw, {_WORDS.format(c=text)})) AS score, len(qw) AS n FROM qw, {table} WHERE list_has_any(qw, {_WORDS.format(c=text)})),
{name}_top AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, key) AS rank FROM {name}_hits QUALIFY rank <= 3),
{name} AS (SELECT question_id, key, rank FROM (SELECT *, max(score) OVER (PARTITION BY question_id) AS best FROM {name}_top) WHERE best < n OR score = n)"""


_NUMBER = r"'\bIS\s*[:-]?\s*([0-9]{{2,6}})(?:\s*[:-]\s*([0-9]{{4}}))?', {g}, 'i'"
_RESOLVED = f"""{_ASKED}, qw AS (SELECT question_id, {_WORDS.format(c='text')} AS qw FROM q), n AS (SELECT *, regexp_extract(text, {_NUMBER.format(g=1)}) AS en, regexp_extract(text, {_NUMBER.format(g=2)}) AS ey, regexp_extract(coalesce(context, ''), {_NUMBER.format(g=1)}) AS cn FROM q),
explicit AS (SELECT question_id, arg_min(standard_id, (-year, standard_id)) AS standard_id FROM n JOIN standards ON CAST(number AS VARCHAR) = en AND (ey = '' OR year = TRY_CAST(ey AS INTEGER)) GROUP BY 1),
context AS (SELECT question_id, arg_min(standard_id, (-year, standard_id)) AS standard_id FROM n JOIN standards ON CAST(number AS VARCHAR) = cn WHERE en = '' GROUP BY 1),
{_most_words('named', 'products', 'product_id', 'name')}, {_most_words('titled', 'standards', 'standard_id', 'title')},
linked AS (SELECT question_id, e.standard_id, min(rank) AS first FROM named JOIN edges e ON product_id = key GROUP BY 1, 2),
tiers AS (SELECT question_id, 0 AS i, 'EXPLICIT' AS tier, 1 AS rank, standard_id FROM explicit UNION ALL SELECT question_id, 1, 'CONTEXT', 1, standard_id FROM context
  UNION ALL SELECT question_id, 2, 'PRODUCT', row_number() OVER (PARTITION BY question_id ORDER BY first, standard_id) AS r, standard_id FROM linked QUALIFY r <= 3 UNION ALL SELECT question_id, 3, 'TITLE', rank, key FROM titled),
resolved AS (SELECT question_id, tier, rank::INTEGER AS rank, standard_id FROM (SELECT *, min(i) OVER (PARTITION BY question_id) AS least FROM tiers) WHERE i = least)"""


@query(f"WITH {_RESOLVED} SELECT * FROM resolved")
def batch_resolve(spark, sf_dir):
    questions, standards, products, edges, _ = _tables(spark, sf_dir)
    return batch.resolve(questions, standards, products, edges)


def _hits(most: int) -> str:
    """SQL of the chunks of each question: those of its standards, then all, each once."""
    return f"""scored AS (SELECT question_id, chunk_id, number, round(list_cosine_similarity(c.vector, q.vector), 12) AS score FROM q, chunks c),
places AS (SELECT question_id, CAST(number AS BIGINT) AS number, min(rank) AS place FROM resolved JOIN standards USING (standard_id) WHERE rank <= {most} GROUP BY ALL),
own AS (SELECT question_id, chunk_id, score, 1 AS source, place, row_number() OVER (PARTITION BY question_id, place ORDER BY score DESC, chunk_id) AS i FROM scored JOIN places USING (question_id, number) QUALIFY i <= 3),
general AS (SELECT question_id, chunk_id, score, 2 AS source, 0 AS place, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS i FROM scored QUALIFY i <= 8),
hits AS (SELECT * FROM (SELECT * FROM own UNION ALL SELECT * FROM general) QUALIFY row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY source, place, i) = 1)"""


_KINDS = [
    ("product", "SELECT standard_id, name AS label FROM edges JOIN products USING (product_id)", 3), ("qco", "SELECT n_nationkey * 2 AS standard_id, n_name AS label FROM nation", 3), ("scheme", "SELECT c_nationkey * 2 AS standard_id, c_mktsegment AS label FROM customer", 3),
    ("test", "SELECT l_suppkey * 2 AS standard_id, l_returnflag || l_linenumber AS label FROM lineitem", 5), ("lab", "SELECT s_nationkey * 2 AS standard_id, s_name AS label FROM supplier", 5), ("product_manual", "SELECT r_regionkey * 2 AS standard_id, r_name AS label FROM region", 2),
]
_RELATED = " UNION ALL ".join(f"SELECT standard_id, {at} AS part, '{kind}' AS kind, row_number() OVER (PARTITION BY standard_id ORDER BY label) AS i, label FROM (SELECT DISTINCT standard_id, label FROM ({sql}) WHERE label IS NOT NULL) QUALIFY i <= {cap}" for at, (kind, sql, cap) in enumerate(_KINDS, 1))


@query(f"""WITH {_RESOLVED}, {_hits(3)}, related AS (SELECT standard_id, 0 AS part, 'standard' AS kind, 1 AS i, number || ' ' || title AS label FROM standards UNION ALL {_RELATED}),
every AS (SELECT question_id, 0 AS s, rank, part, i, 'record' AS source, kind, CAST(standard_id AS VARCHAR) AS ref, label AS text FROM resolved JOIN related USING (standard_id)
  UNION ALL SELECT question_id, source, place, 0, i, 'chunk', coalesce(document_type, '-'), CAST(chunk_id AS VARCHAR), left(title, 60) FROM hits JOIN chunks USING (chunk_id))
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY s, rank, part, i)::INTEGER AS nth, source, kind, ref, text FROM every""")
def batch_evidence(spark, sf_dir):
    questions, standards, products, edges, chunks = _tables(spark, sf_dir)
    resolved = written(batch.resolve(questions, standards, products, edges), "resolved")
    of = lambda t, key, label: load(spark, sf_dir, t).select((F.expr(key) * 2).cast("long").alias("standard_id"), F.expr(label).alias("label"))
    tables = [
        edges.join(products, "product_id").select("standard_id", F.col("name").alias("label")), of("nation", "n_nationkey", "n_name"), of("customer", "c_nationkey", "c_mktsegment"), of("lineitem", "l_suppkey", "l_returnflag || l_linenumber"), of("supplier", "s_nationkey", "s_name"),
        of("region", "r_regionkey", "r_name"),
    ]
    return batch.evidence(questions, resolved, standards, [(kind, df, cap) for (kind, _, cap), df in zip(_KINDS, tables, strict=True)], chunks)


@query(f"""WITH {_RESOLVED}, {_hits(2)}, asked AS (SELECT question_id, list_filter(string_split(lower(text), ' '), lambda t: length(t) >= 3) AS terms FROM q), numbers AS (SELECT question_id, list(number) AS numbers FROM resolved JOIN standards USING (standard_id) GROUP BY 1),
r AS (SELECT question_id, chunk_id, length(content) AS l, round(least(score + (CASE WHEN list_contains(coalesce(numbers, []), c.number) THEN 0.35 ELSE 0 END) + (CASE upper(document_type) WHEN 'IS_STANDARD' THEN 0.30 WHEN 'FAQ' THEN 0.08 ELSE 0 END) + (CASE WHEN len(list_filter(terms, lambda t: contains(lower(title), t))) > 0 THEN 0.04 ELSE 0 END)
  + (CASE WHEN clause IS NOT NULL THEN 0.03 ELSE 0 END) + 0.01 + (CASE WHEN trim(version) <> '' THEN 0.02 ELSE 0 END) + (CASE WHEN contains(coalesce(source_url, ''), '.gov') THEN 0.05 ELSE 0 END) - (CASE WHEN length(content) < 60 THEN 0.02 ELSE 0 END), 1.0), 4) AS relevance
  FROM hits JOIN chunks c USING (chunk_id) JOIN asked USING (question_id) LEFT JOIN numbers USING (question_id))
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY relevance DESC, l DESC, chunk_id)::INTEGER AS rank, chunk_id, relevance FROM r QUALIFY rank <= 6""")
def batch_reranked(spark, sf_dir):
    questions, standards, products, edges, chunks = _tables(spark, sf_dir)
    resolved = written(batch.resolve(questions, standards, products, edges), "resolved")
    return batch.reranked(questions, resolved, standards, chunks)
