"""Set similarity and the classes of similar names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions.text import tokens


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays as sets, four places; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.round(F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union), 4)


def name_class(a: Column, b: Column) -> Column:
    """Struct (cls, score): EXACT_DUPLICATE, LIKELY_DUPLICATE, RELATED_RECORD or DIFFERENT_ENTITY."""
    ta, tb = tokens(a), tokens(b)
    both, union = F.size(F.array_intersect(ta, tb)), F.size(F.array_union(ta, tb))
    j = both / union
    inside = (both == F.size(ta)) | (both == F.size(tb))

    def out(cls: str, score: Column) -> Column:
        return F.struct(F.lit(cls).alias("cls"), score.cast("double").alias("score"))

    return (
        F.when(a == b, out("EXACT_DUPLICATE", F.lit(1.0)))
        .when((F.size(ta) == 0) | (F.size(tb) == 0), out("DIFFERENT_ENTITY", F.lit(0.0)))
        .when((both == F.size(ta)) & (both == F.size(tb)), out("LIKELY_DUPLICATE", F.lit(0.99)))
        .when((j >= 0.60) | inside, out("LIKELY_DUPLICATE", F.round(j, 4)))
        .when(j >= 0.34, out("RELATED_RECORD", F.round(j, 4)))
        .otherwise(out("DIFFERENT_ENTITY", F.round(j, 4)))
    )
