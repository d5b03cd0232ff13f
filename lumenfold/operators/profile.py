"""Column and table profiles, content signatures, keyword scores and exact duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import is_empty, is_placeholder, norm_cell, row_hash
from lumenfold.functions.values import cell_kind, infer_type, is_list


def as_text(df: DataFrame) -> DataFrame:
    return df.select([F.col(c).cast("string").alias(c) for c in df.columns])


def cells(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(keep..., column, value): one row a cell, values as text."""
    keep = keep or []
    rest = [c for c in df.columns if c not in keep]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in rest]))
    return df.select(*keep, each.alias("cell")).select(*keep, "cell.*")


def profile_columns(df: DataFrame) -> DataFrame:
    """One row a column: counts of nulls, placeholders and distinct normalised values, shares, type.

    Values are counted first by column and value, so the second aggregation sees distinct values only.
    """
    counted = cells(df).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    empty, placeholder = is_empty(F.col("value")), is_placeholder(F.col("value"))
    counted = counted.select(
        "column", "n", empty.alias("empty"), placeholder.alias("placeholder"), norm_cell(F.col("value")).alias("norm"),
        cell_kind(F.col("value")).alias("kind"), is_list(F.col("value")).alias("packed"),
    )
    informative = ~F.col("empty") & ~F.col("placeholder")
    by_norm = counted.groupBy("column", "norm").agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("empty"), F.col("n")).otherwise(0)).alias("nulls"),
        F.sum(F.when(F.col("placeholder"), F.col("n")).otherwise(0)).alias("placeholders"),
        F.sum(F.when(informative & F.col("packed"), F.col("n")).otherwise(0)).alias("packed"),
        F.collect_set(F.when(informative, F.col("kind"))).alias("kinds"),
        F.max(informative).alias("informative"),
    )
    out = by_norm.groupBy("column").agg(
        F.sum("total").alias("total_rows"),
        F.sum("nulls").alias("null_rows"),
        F.sum("placeholders").alias("placeholder_rows"),
        F.sum("packed").alias("packed"),
        F.sum(F.col("informative").cast("long")).alias("unique_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds"),
    )
    filled = F.col("total_rows") - F.col("null_rows")
    useful = filled - F.col("placeholder_rows")
    return out.select(
        "column", "total_rows", "null_rows", "placeholder_rows", "unique_count",
        (useful - F.col("unique_count")).alias("duplicate_count"),
        F.round(100 * filled / F.col("total_rows"), 2).alias("percentage_populated"),
        F.round(100 * useful / F.col("total_rows"), 2).alias("percentage_informative"),
        F.round(F.when(useful > 0, F.col("packed") / useful).otherwise(0.0), 4).alias("multivalue_ratio"),
        infer_type(F.col("kinds")).alias("data_type"),
    )


def examples(df: DataFrame, order: str, n: int = 3, width: int = 70) -> DataFrame:
    """(column, examples): the first ``n`` distinct informative values by ``order``, cut to ``width``, joined by `` | ``."""
    found = cells(df, [order]).where(~is_empty(F.col("value")) & ~is_placeholder(F.col("value")))
    first = found.groupBy("column", "value").agg(F.min(order).alias("at"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy("at", "value"))).where(F.col("rank") <= n)
    rows = F.array_sort(F.collect_list(F.struct("rank", F.substring("value", 1, width).alias("v"))))
    return ranked.groupBy("column").agg(F.array_join(F.transform(rows, lambda r: r["v"]), " | ").alias("examples"))


def with_row_hash(df: DataFrame, name: str = "row_hash") -> DataFrame:
    return df.withColumn(name, row_hash([norm_cell(F.col(c)) for c in df.columns]))


def table_profile(df: DataFrame) -> DataFrame:
    """One row: rows, rows that aren't blank, null cells, placeholders, unique and duplicate rows."""
    blank = reduce(lambda a, b: a & b, [is_empty(F.col(c)) for c in df.columns])
    nulls = reduce(lambda a, b: a + b, [is_empty(F.col(c)).cast("long") for c in df.columns])
    marks = reduce(lambda a, b: a + b, [is_placeholder(F.col(c)).cast("long") for c in df.columns])
    per = df.select(blank.alias("blank"), nulls.alias("nulls"), marks.alias("marks"), row_hash([norm_cell(F.col(c)) for c in df.columns]).alias("h"))
    by_hash = per.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("nulls").alias("nulls"), F.sum("marks").alias("marks"), F.sum(F.col("blank").cast("long")).alias("blank"))
    out = by_hash.agg(F.sum("n").alias("total_rows"), F.sum("blank").alias("blank"), F.sum("nulls").alias("null_cells"), F.sum("marks").alias("placeholder_cells"), F.count(F.lit(1)).alias("unique_rows"))
    return out.select("total_rows", (F.col("total_rows") - F.col("blank")).alias("non_blank_rows"), "null_cells", "placeholder_cells", "unique_rows", (F.col("total_rows") - F.col("unique_rows")).alias("duplicate_rows"))


def _folded(h: Column) -> Column:
    """A signature of a set of hashes that partial sums can be merged to: their sum, their exclusive or and their count."""
    number = F.conv(F.substring(h, 1, 15), 16, 10).cast("long")
    parts = [F.sum(number.cast("decimal(38,0)")).cast("string"), F.bit_xor(number).cast("string"), F.count(F.lit(1)).cast("string")]
    return F.sha2(F.concat_ws(":", *parts), 256)


def signatures(df: DataFrame, order: str) -> DataFrame:
    """One row: signatures of a table as an ordered content and as a multiset of rows.

    Both fold row hashes by sums, so no task gathers a table; the ordered one hashes each row with its place.
    """
    row = row_hash([norm_cell(F.col(c)) for c in df.columns])
    hashed = df.select(row.alias("h"), F.sha1(F.concat_ws(":", F.col(order).cast("string"), row).cast("binary")).alias("placed"))
    return hashed.agg(F.count(F.lit(1)).alias("n_rows"), _folded(F.col("h")).alias("row_set_signature"), _folded(F.col("placed")).alias("content_signature"))


def row_duplicates(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """Groups of rows with equal normalised values: hash, size, first and last row."""
    hashed = df.select(F.col(row_id).alias("row_id"), row_hash([norm_cell(F.col(c)) for c in columns]).alias("row_hash"))
    grouped = hashed.groupBy("row_hash").agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))
    return grouped.where("n_rows > 1")


def keyword_scores(text: Column, rules: list[tuple[str, list[str], list[str]]], strong: int = 3, weak: int = 1) -> list[Column]:
    """A score for each rule (name, strong keywords, weak keywords): keywords are looked for in the lower-cased text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    points = lambda words, k: [F.when(low.contains(w), k).otherwise(0) for w in words]
    return [reduce(lambda a, b: a + b, [F.lit(0), *points(s, strong), *points(w, weak)]).alias(name) for name, s, w in rules]


def best_rule(scores: list[tuple[str, Column]], least: int = 1, otherwise: str = "OTHER") -> Column:
    """Struct (label, score) of the highest score; the first rule wins ties."""
    top = F.greatest(F.lit(0), *[c for _, c in scores])
    label = reduce(lambda w, s: w.when((s[1] == top) & (top >= least), s[0]), scores, F.when(F.lit(False), "")).otherwise(otherwise)
    return F.struct(label.alias("label"), top.alias("score"))


def duplicate_groups(files: DataFrame) -> DataFrame:
    """Group files (file_id, sha256, content, family) by equal bytes, then content, then name family; the first basis wins."""
    out = files
    for basis in ("sha256", "content", "family"):
        again = files.where(F.coalesce(F.col(basis), F.lit("")) != "").groupBy(basis).agg(F.count(F.lit(1)).alias(f"__n_{basis}"), F.min("file_id").alias(f"__first_{basis}"))
        out = out.join(again.where(f"__n_{basis} > 1"), basis, "left")
    basis = F.when(F.col("__n_sha256").isNotNull(), "BYTES").when(F.col("__n_content").isNotNull(), "CONTENT").when(F.col("__n_family").isNotNull(), "NAME")
    first = F.coalesce("__first_sha256", "__first_content", "__first_family")
    return out.select("file_id", basis.alias("basis"), first.alias("group_id")).where("basis IS NOT NULL")


def dominant_value(df: DataFrame, column: str, rules: list[tuple[str, str]], share: float = 0.6, hits: int = 3) -> DataFrame:
    """(column, label, n, ratio) of the label that dominates a column, its first rule winning in each cell; no row if none does."""
    c = F.col(column).cast("string")
    label = reduce(lambda w, r: w.when(c.rlike(r[0]), r[1]), rules, F.when(F.lit(False), "")).otherwise(F.lit(None))
    counted = df.select(label.alias("label")).where("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    all_hits = counted.agg(F.sum("n").alias("bearing"))
    # one row of one number
    top = counted.join(F.broadcast(all_hits), F.lit(True)).withColumn("ratio", F.col("n") / F.col("bearing"))
    good = (F.col("ratio") >= share) & ((F.col("n") >= hits) | (F.col("ratio") >= 0.5))
    return top.where(good).orderBy(F.desc("n"), "label").limit(1).select(F.lit(column).alias("column"), "label", "n", F.round("ratio", 4).alias("ratio"))
