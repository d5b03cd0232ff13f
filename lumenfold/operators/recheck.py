"""An audit that is done again after documents changed, at the cost of the change.

The first check extracts evidence from all documents and decides all requirements. Its state is kept as
tables: digests of documents and requirements, evidence, candidates and decisions. A recheck extracts
only documents whose digest is new, drops what came from documents that are gone, and decides only the
requirements that dropped or new evidence reaches; the rest is carried over, and the result is that of a
first check of everything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators import audit
from lumenfold.storage import bounded, written


@dataclass
class Audit:
    """Tables of a check. work: one row, (n_documents, n_extracted, n_reused, n_evidence, n_decided)."""

    documents: DataFrame
    requirements: DataFrame
    evidence: DataFrame
    candidates: DataFrame
    decisions: DataFrame
    work: DataFrame
    today: str
    rules: list


REQUIREMENT = ["requirement_id", "requirement", "type", "evidence_expected"]
CANDIDATE = ["requirement_id", "requirement", "type", "evidence_expected", "evidence_id", "doc_id", "category", "field", "value", "text", "support"]


def _digested(docs: DataFrame) -> DataFrame:
    """(doc_id, category, text, digest); of rows with one id that of the least digest stands, and a null id is none."""
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("category", F.lit("OTHER")).alias("category"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    marked = texts.withColumn("digest", F.sha2(F.concat_ws("\n", "category", "text"), 256))
    return marked.groupBy("doc_id").agg(F.min(F.struct("digest", "category", "text")).alias("x")).select("doc_id", "x.category", "x.text", "x.digest")


def _marked(requirements: DataFrame) -> DataFrame:
    return requirements.select(*REQUIREMENT, F.sha2(F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in REQUIREMENT]), 256).alias("digest"))


def _extracted(docs: DataFrame, rules: list) -> DataFrame:
    """(evidence_id, doc_id, category, field, value, text) of the documents; the id says the document's digest and the place."""
    found = audit.extract_evidence(docs, rules, "doc_id", "category").select("doc_id", "seq", "field", "value", "text")
    return found.join(docs.select("doc_id", "category", "digest"), "doc_id").select(F.concat_ws("-", "doc_id", F.substring("digest", 1, 8), F.col("seq").cast("string")).alias("evidence_id"), "doc_id", "category", "field", "value", "text")


def _worked(documents: DataFrame, fresh: DataFrame, evidence: DataFrame, decided: DataFrame) -> DataFrame:
    n = lambda df, name: df.agg(F.count("*").alias(name))
    one = n(documents, "n_documents").join(F.broadcast(n(fresh, "n_extracted")), F.lit(True)).join(F.broadcast(n(evidence, "n_evidence")), F.lit(True)).join(F.broadcast(n(decided, "n_decided")), F.lit(True))  # one row each
    return one.select("n_documents", "n_extracted", (F.col("n_documents") - F.col("n_extracted")).alias("n_reused"), "n_evidence", "n_decided")


def check(docs: DataFrame, requirements: DataFrame, today: str, rules: list = audit.FIELD_RULES) -> Audit:
    """A first check of documents (doc_id, category, text) against requirements (``REQUIREMENT``)."""
    spark, nothing = docs.sparkSession, "doc_id string, digest string"
    empty = Audit(
        spark.createDataFrame([], nothing), spark.createDataFrame([], "requirement_id string, digest string"), spark.createDataFrame([], "evidence_id string, doc_id string, category string, field string, value string, text string"),
        spark.createDataFrame([], ", ".join(f"{c} {'double' if c == 'support' else 'string'}" for c in CANDIDATE)), spark.createDataFrame([], "requirement_id string, type string, decision string, reason_code string, best_support double, n_candidates long, n_matched long"),
        spark.createDataFrame([], "n_documents long"), today, rules,
    )
    return recheck(empty, docs, requirements, today)


def recheck(state: Audit, docs: DataFrame, requirements: DataFrame, today: str | None = None) -> Audit:
    """The audit of all of ``docs``, from the state of an earlier one.

    Another day counts for calibrations alone, whose certificates expire. Requirements that are new or
    have changed meet all evidence; those that are gone lose their decisions.
    """
    today = today or state.today
    every, asked = _digested(docs), _marked(requirements)
    now = written(every.select("doc_id", "digest"), "digests")
    fresh = written(now.join(bounded(state.documents, 128), ["doc_id", "digest"], "left_anti"), "fresh")
    gone = written(state.documents.join(bounded(now, 128), ["doc_id", "digest"], "left_anti").select("doc_id"), "gone")
    more = written(_extracted(every.join(bounded(fresh, 128), ["doc_id", "digest"], "left_semi"), state.rules), "more-evidence")
    kept = state.evidence.join(bounded(gone, 64), "doc_id", "left_anti")
    evidence = written(kept.unionByName(more), "evidence")

    asked = written(asked, "requirements")
    changed = asked.join(state.requirements, ["requirement_id", "digest"], "left_anti")
    same = asked.join(state.requirements, ["requirement_id", "digest"], "left_semi")
    held = state.candidates.join(bounded(gone, 64), "doc_id", "left_anti").join(bounded(same.select("requirement_id"), 64), "requirement_id", "left_semi")
    found = audit.match_requirements(same.select(REQUIREMENT), more).unionByName(audit.match_requirements(changed.select(REQUIREMENT), evidence))
    found = written(found.select(*CANDIDATE), "more-candidates")
    candidates = written(held.unionByName(found), "candidates")

    lost = state.candidates.join(bounded(gone, 64), "doc_id", "left_semi")
    reached = [lost.select("requirement_id"), found.select("requirement_id"), changed.select("requirement_id")]
    if today != state.today:
        reached.append(asked.where("type = 'CALIBRATION'").select("requirement_id"))
    touched = reached[0]
    for df in reached[1:]:
        touched = touched.union(df)
    touched = written(asked.join(bounded(touched.distinct(), 64), "requirement_id", "left_semi"), "touched")
    ids = bounded(touched.select("requirement_id"), 64)
    again = audit.decide(touched, candidates.join(ids, "requirement_id", "left_semi"), today)
    left = state.decisions.join(bounded(asked.select("requirement_id"), 64), "requirement_id", "left_semi").join(ids, "requirement_id", "left_anti")
    decisions = written(again.unionByName(left), "decisions")
    return Audit(now, asked.select("requirement_id", "digest"), evidence, candidates, decisions, _worked(now, fresh, evidence, touched), today, state.rules)
