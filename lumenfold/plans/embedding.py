"""Hashed vectors of documents, and which shards of them are made anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions.text import SEARCH_STOPWORDS
from lumenfold.operators import vectors
from lumenfold.plans.registry import load, query

_STOP = "(" + ", ".join(f"'{w}'" for w in SEARCH_STOPWORDS) + ")"
_TERMS = f"t AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 3 AND x NOT IN {_STOP})) AS word FROM documents) GROUP BY ALL)"


def _chunks(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


@query(f"""WITH {_TERMS}, f AS (SELECT word, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM t GROUP BY 1),
w AS (SELECT doc_id, ('0x' || left(md5(word), 7))::BIGINT % 64 AS place, sum((CASE WHEN substring(md5(word), 8, 1) < '8' THEN 1 ELSE -1 END) * tf * idf) AS w FROM t JOIN f USING (word) GROUP BY 1, 2), l AS (SELECT doc_id, sqrt(sum(w * w)) AS length FROM w GROUP BY 1)
SELECT doc_id AS chunk_id, place, CAST(round(w / length, 6) AS DOUBLE) AS value FROM w JOIN l USING (doc_id) WHERE abs(w / length) > 0.000001""")
def chunk_vectors(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    made = vectors.embed(chunks, vectors.fit_idf(chunks))
    return made.select("chunk_id", F.posexplode("vector").alias("place", "value")).where("abs(value) > 0.000001").select("chunk_id", F.col("place").cast("long").alias("place"), F.round("value", 6).alias("value"))


@query("""WITH n AS (SELECT doc_id, text, (row_number() OVER (ORDER BY doc_id) - 1) // 128 AS shard FROM documents), last AS (SELECT max(doc_id) AS m FROM documents)
SELECT shard, count(*) AS n_chunks, bool_or(doc_id % 400 = 7 AND text <> '') OR shard = (SELECT max(shard) FROM n) AS made FROM n GROUP BY shard""")
def shard_reuse(spark, sf_dir):
    """The shards that are made anew after some texts changed and the last chunk came."""
    chunks = _chunks(spark, sf_dir)
    last = chunks.agg(F.max("chunk_id").alias("m"))
    before = chunks.join(F.broadcast(last), F.lit(True)).where("chunk_id < m").select("chunk_id", F.when(F.col("chunk_id") % 400 == 7, "").otherwise(F.col("content")).alias("content"))
    idf = vectors.fit_idf(chunks)
    held, _ = vectors.refreshed(before, None, idf, 128)
    now, work = vectors.refreshed(chunks, held, idf, 128)
    sizes = now.groupBy("shard").agg(F.count("*").alias("n_chunks"))
    return sizes.join(work, "shard").select("shard", "n_chunks", "made")
