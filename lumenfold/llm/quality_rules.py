"""Operator 10, host-level quality rules, in Spark SQL functions only.

Every document gets exact text statistics and a base verdict. Rule failures are then summed by host
(the ``source`` column), each host's failure rate is shrunk towards the corpus by a beta prior fitted
to the hosts themselves, and the host's verdict is joined back to its documents.

Defined results: a null or empty text has no words and fails; very long texts are measured whole; a
null host is a host of its own; repeated rows count once each; a rate equal to the limit rejects;
columns of any name stay as they are, but those named as the results are replaced; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import SPACE, bounded, drop_clashing, nested, table, text_or_empty, written

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: A host is rejected if its shrunk failure rate reaches this.
HOST_MAX_RATE = 0.75
#: The prior never weighs more than this many documents.
MAX_PRIOR_DOCS = 1000.0
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words(text: Column) -> Column:
    stripped = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, f"[{SPACE}]+"))


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more.

    Windows are sorted by (hash, start); those equal to a neighbour are repeats. Over the repeats'
    sorted starts, each window adds the words up to the next start, eight at most.
    """
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    left = F.concat(F.array(F.lit(None).cast("long")), F.slice(F.transform(pairs, lambda p: p["h"]), 1, F.greatest(F.size(pairs) - 1, F.lit(0))))
    right = F.concat(F.slice(F.transform(pairs, lambda p: p["h"]), 2, F.greatest(F.size(pairs) - 1, F.lit(0))), F.array(F.lit(None).cast("long")))
    marked = F.zip_with(F.zip_with(pairs, left, lambda p, x: F.struct(p["h"].alias("h"), p["i"].alias("i"), p["h"].eqNullSafe(x).alias("l"))), right, lambda p, x: F.struct(p["i"].alias("i"), (p["l"] | p["h"].eqNullSafe(x)).alias("repeat")))
    starts = F.array_sort(F.transform(F.filter(marked, lambda m: m["repeat"]), lambda m: m["i"]))
    nexts = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.lit(2**31 - 1)))
    covered = F.zip_with(starts, nexts, lambda a, b: F.least(b - a, F.lit(WINDOW)).cast("long"))
    return F.aggregate(covered, F.lit(0).cast("long"), lambda acc, x: acc + x)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the five statistics and ``base_failed``."""
    t = text_or_empty(text)
    df = drop_clashing(docs, [*STATS, "base_failed", "__words", "__hashes", "__lines"])
    df = df.withColumn("__words", words(t)).withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    df = df.withColumn(
        "__hashes",
        F.when(F.size("__words") > WINDOW, F.transform(F.sequence(F.lit(1), F.size("__words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("__words"), i, WINDOW)))),
    )
    df = df.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.when(F.size(F.array_distinct("__hashes")) < F.size("__hashes"), _repeat_words(F.col("__hashes"))).otherwise(F.lit(0)).cast("long"),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("__words", "__hashes", "__lines")


def host_verdicts(stats: DataFrame, host: str = "host", max_rate: float = HOST_MAX_RATE) -> DataFrame:
    """One row a host: documents, failures, failure rate shrunk by the empirical beta prior, verdict.

    The prior comes from the hosts' rates by the method of moments. With one host, or hosts that differ
    no more than chance, its weight is ``MAX_PRIOR_DOCS`` documents.
    """
    hosts = stats.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    prior = hosts.agg(
        (F.sum("host_failed") / F.sum("host_docs")).alias("mean"),
        F.var_pop(rate).alias("var"),
        F.avg(1 / F.col("host_docs")).alias("inverse"),
    )
    spread = F.greatest(F.col("var") - F.col("mean") * (1 - F.col("mean")) * F.col("inverse"), F.lit(0.0))
    room = F.col("mean") * (1 - F.col("mean"))
    weight = F.when(spread <= 0, F.lit(MAX_PRIOR_DOCS)).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(MAX_PRIOR_DOCS), room / spread - 1)))
    prior = prior.select("mean", weight.alias("weight"))
    # one row of two numbers joins every host
    joined = hosts.join(F.broadcast(prior), F.lit(True))
    shrunk = (F.col("host_failed") + F.col("mean") * F.col("weight")) / (F.col("host_docs") + F.col("weight"))
    return joined.select("host", "host_docs", "host_failed", shrunk.alias("host_rate")).withColumn("host_rejected", F.col("host_rate") >= max_rate)


def quality_rules(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """Statistics, verdicts and host columns for each row; the text itself isn't returned."""
    docs = drop_clashing(docs, [*STATS, "base_failed", "host_docs", "host_failed", "host_rate", "host_rejected", "kept"])
    stats = written(with_statistics(nested(docs, text, host=F.col(host), text=F.col(text))).drop("text"), "quality")
    hosts = host_verdicts(stats)
    judged = stats.join(hosts.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")), "left")
    judged = judged.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_rejected"), F.lit(False)))
    return judged.select("row.*", *STATS, "base_failed", "host_docs", "host_failed", "host_rate", "host_rejected", "kept")


def _text_hash(text: str) -> dict[str, Column]:
    """128 bits of a text, a null one as an empty one."""
    t = text_or_empty(text)
    return {"high": F.xxhash64(t), "low": F.xxhash64(F.lit(1), t)}


def keep_good(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs``, columns unchanged, that pass their own rules and whose host passes.

    The rules run once. A row's own verdict depends on its text alone, so the hashes of the texts that
    fail take the rows out; they are broadcast if they are few enough, and joined otherwise.
    """
    judged = _held(with_statistics(docs.select(F.col(host).alias("host"), F.col(text).alias("text"), *[c.alias(n) for n, c in _text_hash(text).items()])).select("host", "base_failed", "high", "low"))
    judged = written(judged.select("host", "base_failed", *[F.when(F.col("base_failed"), F.col(c)).alias(c) for c in ("high", "low")]), "judged")
    failed = written(judged.where("base_failed").select("high", "low").distinct(), "failed")
    rejected = written(host_verdicts(judged).where("host_rejected").select(F.col("host").alias("rejected")), "rejected")
    rows = nested(docs, host=F.col(host), **_text_hash(text)).join(bounded(failed), ["high", "low"], "left_anti")
    return rows.join(bounded(rejected, 256), F.col("host").eqNullSafe(F.col("rejected")), "left_anti").select("row.*")


def _held(df: DataFrame) -> DataFrame:
    """``df`` as it is. A filter on its columns stays above them, and so doesn't repeat what they are computed from."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", *STATS, "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))


SQL_STATS = r"""
words AS (
  SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)),
wins AS (
  SELECT rid, i, array_to_string(w[i:i+7], ' ') AS win
  FROM (SELECT row_number() OVER () AS rid, w FROM words) x, unnest(range(1, len(w) - 6)) u(i)),
rep AS (
  SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM wins) WHERE n > 1),
cov AS (SELECT rid, sum(least(coalesce(nxt - i, 8), 8)) AS covered FROM rep GROUP BY rid),
stats AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(covered, 0)::BIGINT AS n_repeat_words
  FROM (SELECT row_number() OVER () AS rid, * FROM words) LEFT JOIN cov USING (rid)),
judged AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM stats),
hosts AS (
  SELECT source AS host, count(*) AS n, sum(base_failed::INT) AS f FROM judged GROUP BY source),
prior AS (
  SELECT sum(f) / sum(n) AS m, greatest(var_pop(f / n) - (sum(f) / sum(n)) * (1 - sum(f) / sum(n)) * avg(1 / n), 0) AS v FROM hosts),
rated AS (
  SELECT host, (f + m * k) / (n + k) AS host_rate FROM hosts,
    (SELECT m, CASE WHEN v <= 0 THEN 1000.0 ELSE greatest(1.0, least(1000.0, m * (1 - m) / v - 1)) END AS k FROM prior))
"""

SQL = f"""WITH {SQL_STATS}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND NOT host_rate >= {HOST_MAX_RATE}) AS kept, round(host_rate, 6) AS host_rate
FROM judged JOIN rated ON source IS NOT DISTINCT FROM host"""
