"""Conflicts between two values of one field: which rule explains them, what follows, which value stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import null_class, punctuation_free, squeeze
from lumenfold.storage import bounded

# Each rule's status and confidence.
POLICY = [
    ("SAME_VALUE_DIFFERENT_FORMAT", "RESOLVED", 1.00),
    ("ONE_SIDE_NULL", "RESOLVED", 0.95),
    ("ONE_SIDE_PLACEHOLDER", "RESOLVED", 0.90),
    ("ASSERTED_ABSENCE_VS_VALUE", "REQUIRES_REVIEW", 0.00),
    ("SUBSTRING_ENRICHMENT", "RESOLVED", 0.80),
    ("VERSION_EVIDENCE", "RESOLVED", 0.85),
    ("STATUS_DISAGREEMENT", "UNRESOLVED_PRESERVE_BOTH", 0.00),
    ("DATE_DISAGREEMENT", "UNRESOLVED_PRESERVE_BOTH", 0.00),
    ("NUMERIC_DISAGREEMENT", "UNRESOLVED_PRESERVE_BOTH", 0.00),
    ("FREE_TEXT_DIVERGENCE", "UNRESOLVED_PRESERVE_BOTH", 0.00),
    ("HOMONYM_NOT_A_CONFLICT", "RESOLVED", 1.00),
]


def with_conflict_rule(df: DataFrame, a: str, b: str, kind: Column, newer: Column, homonym: Column | None = None) -> DataFrame:
    """``df`` with ``rule``: the first that explains the values ``a`` and ``b`` of a field.

    kind: the field's semantic type. newer: ``A`` or ``B`` if that side is shown to be the newer version,
    else empty. homonym: whether the two columns mean different fields. A status or a date is never
    settled by one value holding the other.
    """
    facts = df.withColumn("__facts", F.struct(null_class(F.col(a)).alias("ca"), null_class(F.col(b)).alias("cb"), punctuation_free(F.col(a)).alias("na"), punctuation_free(F.col(b)).alias("nb"), (squeeze(F.col(a)) == "").alias("ea"), (squeeze(F.col(b)) == "").alias("eb"), F.upper(kind).alias("kind"), F.coalesce(newer, F.lit("")).alias("newer")))
    f = F.col("__facts")
    absent = (f.ca == "ASSERTED_ABSENCE") | (f.cb == "ASSERTED_ABSENCE")
    inside = (f.na != "") & (f.nb != "") & (f.na.contains(f.nb) | f.nb.contains(f.na))
    rules = [
        (F.coalesce(homonym, F.lit(False)) if homonym is not None else F.lit(False), "HOMONYM_NOT_A_CONFLICT"),
        (f.na == f.nb, "SAME_VALUE_DIFFERENT_FORMAT"),
        (f.ea | f.eb, "ONE_SIDE_NULL"),
        (absent, "ASSERTED_ABSENCE_VS_VALUE"),
        ((f.ca != "POPULATED") | (f.cb != "POPULATED"), "ONE_SIDE_PLACEHOLDER"),
        (inside & ~f.kind.rlike("STATUS|DATE"), "SUBSTRING_ENRICHMENT"),
        (f.newer != "", "VERSION_EVIDENCE"),
        (f.kind.contains("STATUS"), "STATUS_DISAGREEMENT"),
        (f.kind.contains("DATE"), "DATE_DISAGREEMENT"),
        (f.kind.rlike("NUM|COUNT|INT"), "NUMERIC_DISAGREEMENT"),
    ]
    return facts.withColumn("rule", F.coalesce(*[F.when(holds, name) for holds, name in rules], F.lit("FREE_TEXT_DIVERGENCE"))).drop("__facts")


def with_policy(df: DataFrame, policy: list[tuple] = POLICY) -> DataFrame:
    """``df`` with the status and the confidence of its ``rule``."""
    table = F.create_map(*[F.lit(x) for rule, status, confidence in policy for x in (rule, f"{status}|{confidence}")])
    found = F.split(F.element_at(table, F.col("rule")), "\\|")
    return df.withColumns({"status": found[0], "confidence": found[1].cast("double")})


def winner(a: Column, b: Column, newer: Column, rule: Column | None = None) -> Column:
    """The value that the sources themselves settle: the longer of the same or contained, the populated side, the newer side; else empty."""
    rule = F.col("rule") if rule is None else rule
    longer = F.when(F.length(b) > F.length(a), b).otherwise(a)
    filled = F.when(null_class(a) == "POPULATED", a).otherwise(b)
    out = (
        F.when(rule.isin("SAME_VALUE_DIFFERENT_FORMAT", "SUBSTRING_ENRICHMENT"), longer)
        .when(rule.isin("ONE_SIDE_NULL", "ONE_SIDE_PLACEHOLDER"), filled)
        .when(rule == "VERSION_EVIDENCE", F.when(newer == "A", a).otherwise(b))
    )
    return F.coalesce(out, F.lit(""))


def readjudicate(imported: DataFrame, resolved: DataFrame, kind: Column, newer: Column) -> DataFrame:
    """Conflicts (field_a, field_b, value_a, value_b, ...) found elsewhere, judged again.

    resolved: (column, target), what each column means; two columns of different targets are homonyms.
    """
    target = lambda p: bounded(resolved.select(F.col("column").alias(f"field_{p}"), F.col("target").alias(f"target_{p}")))
    both = imported.join(target("a"), "field_a", "left").join(target("b"), "field_b", "left")
    ruled = with_conflict_rule(both, "value_a", "value_b", kind, newer, F.col("target_a") != F.col("target_b"))
    judged = with_policy(ruled)
    return judged.withColumn("winner", F.when(F.col("status") == "RESOLVED", winner(F.col("value_a"), F.col("value_b"), newer)).otherwise(""))
