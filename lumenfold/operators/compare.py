"""Comparison of datasets: schemas, keys, row overlap, conflicts and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.semantics import entity_kind
from lumenfold.functions.similarity import jaccard, name_class
from lumenfold.functions.text import is_empty, norm_cell, norm_header, norm_of, null_class, row_hash, tokens
from lumenfold.operators.profile import cells


def schema_verdict(a: Column, b: Column) -> Column:
    """DISJOINT, IDENTICAL, SUBSET, SUBSTANTIAL, OVERLAP or WEAK for two header sets."""
    both, j = F.size(F.array_intersect(a, b)), jaccard(a, b)
    return (
        F.when(both == 0, "DISJOINT")
        .when((both == F.size(a)) & (both == F.size(b)), "IDENTICAL")
        .when((both == F.size(a)) | (both == F.size(b)), "SUBSET")
        .when(j >= 0.60, "SUBSTANTIAL")
        .when(j >= 0.25, "OVERLAP")
        .otherwise("WEAK")
    )


def schema_pairs(facts: DataFrame) -> DataFrame:
    """All pairs of a small facts table (name, headers), each once, with their schema verdict.

    Facts have one row a dataset, never a row of data; the pairs are a non-equi join of them.
    """
    a = facts.select(F.col("name").alias("a"), F.col("headers").alias("ha"))
    b = facts.select(F.col("name").alias("b"), F.col("headers").alias("hb"))
    pairs = a.join(b, F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.size(F.array_intersect("ha", "hb")).alias("common"), jaccard(F.col("ha"), F.col("hb")).alias("schema_jaccard"), schema_verdict(F.col("ha"), F.col("hb")).alias("verdict"))


def deep_gate(pair: dict[str, Column]) -> Column:
    """Why a pair deserves a row comparison: an array of reasons, empty if it doesn't."""
    reasons = [(name, c) for name, c in pair.items()]
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in reasons]))


def column_stats(df: DataFrame) -> DataFrame:
    """(column, n_rows, filled, distinct_filled) over normalised cells."""
    norm = cells(df).select("column", norm_cell(F.col("value")).alias("v"))
    counted = norm.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("column").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("v") != "", F.col("n")).otherwise(0)).alias("filled"), F.count(F.when(F.col("v") != "", 1)).alias("distinct_filled"))


def key_candidates(a: DataFrame, b: DataFrame, populated: float = 0.9, unique: float = 0.95) -> DataFrame:
    """Common columns that are populated and unique on both sides, with the share of values they have in common."""
    common = [c for c in a.columns if c in b.columns]
    sa, sb = column_stats(a.select(*common)), column_stats(b.select(*common))
    good = lambda p: (F.col(f"{p}.n_rows") >= 2) & (F.col(f"{p}.filled") >= populated * F.col(f"{p}.n_rows")) & (F.col(f"{p}.distinct_filled") >= unique * F.col(f"{p}.filled"))
    able = sa.alias("x").join(sb.alias("y"), "column").where(good("x") & good("y")).select("column", F.col("x.distinct_filled").alias("distinct_a"), F.col("y.distinct_filled").alias("distinct_b"))
    distinct = lambda df: cells(df.select(*common)).select("column", norm_cell(F.col("value")).alias("v")).where("v <> ''").distinct()
    shared = distinct(a).join(distinct(b), ["column", "v"]).groupBy("column").agg(F.count(F.lit(1)).alias("shared"))
    out = able.join(shared, "column", "left").na.fill({"shared": 0})
    return out.select("column", "distinct_a", "distinct_b", "shared", F.when(F.col("shared") == 0, "SURROGATE").otherwise("KEY").alias("role"))


def rank_keys(candidates: DataFrame) -> DataFrame:
    """``candidates`` (column, shares, entity, overlap) of one pair with their ``rank``: those that share values, of an entity, of more overlap, of a shorter name."""
    order = Window.orderBy(F.desc("shares"), F.desc("entity"), F.desc("overlap"), F.length("column"), "column")
    return candidates.withColumn("rank", F.row_number().over(order))  # a row a column


def first_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: that with the least ``order``."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("row")).select(key, "row.*")


def matched_cells(a: DataFrame, b: DataFrame, key: str, columns: list[str], order: str | None = None) -> DataFrame:
    """(key, column, value_a, value_b) of the rows with one key; of a key's rows in ``a`` the first by ``order`` stands.

    Rows meet once and are taken apart after that, so the join moves rows and not cells.
    """
    left = a.select(F.col(key).cast("string").alias("key"), *([F.col(order).alias("order")] if order else [F.struct(*columns).cast("string").alias("order")]), F.struct(*[F.col(c).cast("string").alias(c) for c in columns]).alias("a"))
    right = b.select(F.col(key).cast("string").alias("key"), F.struct(*[F.col(c).cast("string").alias(c) for c in columns]).alias("b"))
    both = left.groupBy("key").agg(F.min_by("a", "order").alias("a")).join(right, "key")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col("a")[c].alias("value_a"), F.col("b")[c].alias("value_b")) for c in columns]))
    return both.where(~is_empty(F.col("key"))).select("key", each.alias("x")).select("key", "x.*")


def record_conflicts(a: DataFrame, b: DataFrame, key: str, columns: list[str], order: str | None = None) -> DataFrame:
    """(key, column, value_a, value_b, kind): same key, both filled, different values.

    kind is FORMAT_VARIANT where the normalised values agree, else DISAGREEMENT.
    """
    met = matched_cells(a, b, key, columns, order)
    differ = met.where(~is_empty(F.col("value_a")) & ~is_empty(F.col("value_b")) & (F.col("value_a") != F.col("value_b")))
    same = norm_cell(F.col("value_a")) == norm_cell(F.col("value_b"))
    return differ.withColumn("kind", F.when(same, "FORMAT_VARIANT").otherwise("DISAGREEMENT"))


def similar_names(df: DataFrame, row_id: str, name: str) -> DataFrame:
    """(id_a, id_b, cls, score, token_jaccard) of names that are copies, likely duplicates or related.

    A name stands by its first row: each further row with it is a pair with that row, and names that
    differ are paired by their first rows. Candidates share a rare token: a token Jaccard of 0.34
    leaves one among the first of both, a name inside another leaves its rarest in the other. So no pair
    of the classes is lost, and a null name is in none.
    """
    rows = df.select(F.col(row_id).alias("id"), F.col(name).alias("x")).where(F.col("x").isNotNull())
    names = rows.groupBy("x").agg(F.min("id").alias("id"))
    copies = rows.join(names.withColumnRenamed("id", "id_a"), "x").where("id <> id_a").select("id_a", F.col("id").alias("id_b"), "x", F.col("x").alias("y"))
    each = names.select("id", F.explode(tokens(F.col("x"))).alias("token"))
    known = each.join(each.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token")
    ranked = known.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("all"))
    size = F.size("all")
    placed = ranked.select("id", (size - F.expr("(34 * size(all) + 99) div 100") + 1).alias("first"), F.posexplode("all").alias("pos", "t")).select("id", "pos", F.col("t.token").alias("token"), (F.col("pos") < F.col("first")).alias("early"))
    side = lambda p, where: placed.where(where).select("token", F.col("id").alias(p))
    met = side("a", "early").join(side("b", "early"), "token").unionByName(side("a", "pos = 0").join(side("b", "pos >= 0"), "token"))
    pairs = met.where("a <> b").select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()
    named = lambda p, x: names.select(F.col("id").alias(p), F.col("x").alias(x))
    both = pairs.join(named("id_a", "x"), "id_a").join(named("id_b", "y"), "id_b").unionByName(copies)
    scored = both.select("id_a", "id_b", name_class(F.col("x"), F.col("y")).alias("c"), jaccard(tokens(F.col("x")), tokens(F.col("y"))).alias("token_jaccard"))
    return scored.where("c.cls <> 'DIFFERENT_ENTITY'").select("id_a", "id_b", "c.cls", "c.score", "token_jaccard")


def row_overlap(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows of each side, rows in common as multisets, their Jaccard."""
    hashes = lambda df, n: df.groupBy(row_hash([norm_of(df, c) for c in columns]).alias("h")).agg(F.count(F.lit(1)).alias(n))
    met = hashes(a, "na").join(hashes(b, "nb"), "h", "full_outer").na.fill(0, ["na", "nb"])
    out = met.agg(F.sum("na").alias("rows_a"), F.sum("nb").alias("rows_b"), F.sum(F.least("na", "nb")).alias("common_rows"))
    union = F.col("rows_a") + F.col("rows_b") - F.col("common_rows")
    return out.withColumn("row_jaccard", F.round(F.when(union > 0, F.col("common_rows") / union).otherwise(0.0), 4))


def key_overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: different filled keys that both sides have, that one alone has, and their Jaccard."""
    keys = lambda df, mark: df.select(norm_of(df, column).alias("k")).where("k <> ''").distinct().withColumn(mark, F.lit(1))
    met = keys(a, "a").join(keys(b, "b"), "k", "full_outer")
    out = met.agg(F.count(F.col("a") + F.col("b")).alias("common"), F.count(F.when(F.col("b").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("a").isNull(), 1)).alias("only_b"))
    total = F.col("common") + F.col("only_a") + F.col("only_b")
    return out.withColumn("jaccard", F.round(F.when(total > 0, F.col("common") / total).otherwise(0.0), 4))


def deep_pair(a: DataFrame, b: DataFrame, key: str | None, entities: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row of facts on two datasets: rows, columns, row overlap, similarity, overlap of keys and of entities, identity.

    ``columns`` are the common ones by default. Row overlap counts in the similarity only if it is
    measured over three common columns and half of the smaller schema.
    """
    common = columns or [c for c in a.columns if c in b.columns]
    union = len({*a.columns, *b.columns})
    reliable = len(common) >= 3 and len(common) >= 0.5 * min(len(a.columns), len(b.columns))
    column_jaccard = round(len(common) / union, 4) if union else 0.0
    rows = row_overlap(a, b, common).withColumns({"common_columns": F.lit(len(common)), "column_jaccard": F.lit(column_jaccard), "reliable": F.lit(reliable)})
    rows = rows.withColumn("similarity", F.round(0.65 * (F.col("row_jaccard") if reliable else F.lit(0.0)) + 0.35 * F.lit(column_jaccard), 4))
    out = rows
    if key:
        # facts of one row each
        out = out.crossJoin(F.broadcast(key_overlap(a, b, key).select(F.col("common").alias("common_keys"), F.col("only_a").alias("only_a_keys"), F.col("only_b").alias("only_b_keys"), F.col("jaccard").alias("key_jaccard"))))
    else:
        out = out.withColumns({"common_keys": F.lit(-1), "only_a_keys": F.lit(-1), "only_b_keys": F.lit(-1), "key_jaccard": F.lit(0.0)})
    shared = [key_overlap(a, b, c).select("jaccard") for c in entities]
    most = reduce(DataFrame.unionByName, shared).agg(F.max("jaccard").alias("entity_jaccard")) if shared else a.sparkSession.range(1).select(F.lit(0.0).alias("entity_jaccard"))
    out = out.crossJoin(F.broadcast(most))
    identity = (
        F.when(F.col("common_keys") > 0, "KEY_LINKED")
        .when(F.col("entity_jaccard") >= 0.30, "SAME_ENTITIES_DIFFERENT_KEY_NAMESPACE")
        .when(F.col("common_keys") == 0, "KEY_DISJOINT_NO_ENTITY_EVIDENCE")
        .otherwise("NO_KEY_AVAILABLE")
    )
    return out.withColumn("identity", identity)


def version_direction(n: Column, a_blank: Column, b_blank: Column, a_artefacts: Column, b_artefacts: Column, share: float = 0.7) -> Column:
    """Struct (newer, evidence) from counts over ``n`` conflicts: the side that fills what the other leaves blank, or cleans it."""

    def out(side: str, evidence: str) -> Column:
        return F.struct(F.lit(side).alias("newer"), F.lit(evidence).alias("evidence"))

    return (
        F.when((b_blank == 0) & (a_blank >= share * n) & (n > 0), out("B", "ENRICHMENT"))
        .when((a_blank == 0) & (b_blank >= share * n) & (n > 0), out("A", "ENRICHMENT"))
        .when((b_artefacts == 0) & (a_artefacts > 0), out("B", "REPAIR"))
        .when((a_artefacts == 0) & (b_artefacts > 0), out("A", "REPAIR"))
        .otherwise(out("", "INCONCLUSIVE"))
    )


#: Marks that a cell was not cleaned after it was read from a page.
ARTEFACT = "(?i)\ufffd|\u00c3|&amp;|\\\\u[0-9a-f]{4}|\\(from [^)]*endpoint\\)"


def conflict_shape(conflicts: DataFrame, by: list[str]) -> DataFrame:
    """Counts of how two sides differ: blanks and artefacts of each side, real disagreements, format variants, mean length and shared words.

    A blank is an empty cell, a placeholder or an asserted absence.
    """
    blank = lambda c: is_empty(F.col(c)) | (norm_cell(F.col(c)) == "") | (null_class(F.col(c)) != "POPULATED")
    mark = lambda c: F.coalesce(F.col(c).rlike(ARTEFACT), F.lit(False))
    length = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    facts = conflicts.withColumns({"blank_a": blank("value_a"), "blank_b": blank("value_b"), "mark_a": mark("value_a"), "mark_b": mark("value_b")})
    facts = facts.withColumns({"real": F.col("blank_a") == F.col("blank_b"), "same": norm_cell(F.col("value_a")) == norm_cell(F.col("value_b")), "j": jaccard(tokens(F.col("value_a")), tokens(F.col("value_b")))})
    count = lambda c: F.sum(c.cast("long"))
    return facts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("key").alias("keys"),
        count(F.col("blank_a") & ~F.col("blank_b")).alias("a_blank"),
        count(~F.col("blank_a") & F.col("blank_b")).alias("b_blank"),
        count(F.col("real") & F.col("mark_a") & ~F.col("mark_b")).alias("a_artefacts"),
        count(F.col("real") & ~F.col("mark_a") & F.col("mark_b")).alias("b_artefacts"),
        count(F.col("real")).alias("both_real"),
        count(F.col("same")).alias("format_variants"),
        F.round(F.avg(F.floor((length("value_a") + length("value_b")) / 2)), 4).alias("mean_length"),
        F.round(F.avg("j"), 4).alias("mean_token_jaccard"),
    )


def homonyms(shapes: DataFrame, matched: Column) -> DataFrame:
    """Columns of one name and two meanings: nearly all matched keys disagree, really, at length, in other words, with no format variant."""
    every = (F.col("keys") >= 0.95 * matched) & (F.col("both_real") >= 0.95 * F.col("n"))
    return shapes.where(every & (F.col("format_variants") == 0) & (F.col("mean_length") >= 40) & (F.col("mean_token_jaccard") < 0.20))


def discriminators(shapes: DataFrame, matched: Column, column: str = "column") -> DataFrame:
    """Columns that hold an entity and disagree on nearly every matched key: the sides are different entities over one key."""
    # as one condition on the counts, so that names are read for columns and not for the rows that were counted
    return shapes.where(F.when((matched > 0) & (F.col("keys") >= 0.99 * matched), entity_kind(norm_header(F.col(column))) != "").otherwise(F.lit(False)))


def same_attributes(verdict: Column, column_jaccard: Column, common: Column, columns_a: Column, columns_b: Column) -> Column:
    """Whether two datasets describe their subjects by the same attributes."""
    alike = verdict.isin("IDENTICAL", "SUBSTANTIAL", "SUBSET") | (column_jaccard >= 0.60) | (common >= 0.60 * F.least(columns_a, columns_b))
    return (columns_a > 0) & (columns_b > 0) & alike


def pair_verdict(p: dict[str, Column]) -> Column:
    """Struct (decision, level, canonical, merged, archived, review) of a pair of datasets; the strictest evidence first.

    ``p`` holds: same_bytes, same_rows, same_attributes, discriminators (how many), conflicts, newer (A, B
    or empty), common_keys (-1 where no key is known), only_a, only_b, key_jaccard, entity_jaccard,
    identity, rows_a, rows_b.
    """
    full = (p["key_jaccard"] >= 0.95) & (p["only_a"] == 0) & (p["only_b"] == 0)
    linked, alike, clash = p["common_keys"] > 0, p["same_attributes"], p["conflicts"] > 0
    all_keys = p["common_keys"] + p["only_a"] + p["only_b"]
    none = F.lit(0)

    def out(decision: str | Column, level: int, canonical: str | Column, merged: Column = none, archived: Column = none, review: Column | bool = False) -> Column:
        of = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(of(decision).alias("decision"), F.lit(level).alias("level"), of(canonical).alias("canonical"), merged.cast("long").alias("merged"), archived.cast("long").alias("archived"), of(review).alias("review"))

    rekey = F.when((p["entity_jaccard"] >= 0.60) & alike, "LIKELY_DUPLICATE").otherwise("COMPLEMENTARY")
    cascade = [
        (p["same_bytes"], out("EXACT_DUPLICATE", 1, "A", archived=p["rows_b"])),
        (p["same_rows"], out("IDENTICAL_CONTENT", 2, "A", archived=p["rows_b"])),
        (full & (p["discriminators"] > 0), out("DIFFERENT_ENTITY", 3, "BOTH_KEEP_SEPARATE", 2 * p["common_keys"], review=True)),
        (full & alike & clash & (p["newer"] != ""), out(F.when(p["newer"] == "B", "VERSION_NEWER").otherwise("VERSION_OLDER"), 4, p["newer"])),
        (full & alike & clash, out("CONFLICTING", 4, "BOTH_PRESERVE_CONFLICTS", review=True)),
        (full & alike, out("LIKELY_DUPLICATE", 4, "A", p["common_keys"], review=True)),
        (full, out("COMPLEMENTARY", 4, "MERGE_UNION", p["common_keys"], review=True)),
        (linked & alike & (p["key_jaccard"] >= 0.30), out("DUPLICATE_WITH_UNIQUE_DATA", 4, "MERGE_UNION", all_keys, review=clash)),
        (linked, out("COMPLEMENTARY", 4, "MERGE_UNION", all_keys, review=~alike | clash)),
        (p["identity"] == "SAME_ENTITIES_DIFFERENT_KEY_NAMESPACE", out(rekey, 4, "MERGE_AFTER_REKEY", p["rows_a"] + p["rows_b"], review=True)),
        ((p["entity_jaccard"] < 0.05) & ~linked, out("DIFFERENT_ENTITY", 3, "BOTH_KEEP_SEPARATE")),
    ]
    return F.coalesce(*[F.when(holds, verdict) for holds, verdict in cascade], out("REQUIRES_REVIEW", 4, "UNDECIDED_REVIEW_REQUIRED", review=True))
