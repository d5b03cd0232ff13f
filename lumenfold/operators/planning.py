"""Which datasets are covered by others, and what a merge of a cluster would give."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def file_slice(df: DataFrame, file_id: str, row_no: str, files: list[str] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """A window of rows of some files; the filters reach the scan."""
    if files:
        df = df.where(F.col(file_id).isin(files))
    if first is not None:
        df = df.where(F.col(row_no) >= first)
    if last is not None:
        df = df.where(F.col(row_no) <= last)
    return df


def coverage(keys: DataFrame) -> DataFrame:
    """For each file of (file_id, key): its keys, those only it has, and the file that covers most of it.

    Keys are counted by the set of files that hold them, so pairs of files are made of sets and not of keys.
    """
    sets = keys.distinct().groupBy("key").agg(F.array_sort(F.collect_set("file_id")).alias("files"))  # a key's files, no rows
    counts = sets.groupBy("files").agg(F.count(F.lit(1)).alias("n"))
    each = counts.select("files", "n", F.explode("files").alias("file_id"))
    own = each.groupBy("file_id").agg(F.sum("n").alias("n_keys"), F.sum(F.when(F.size("files") == 1, F.col("n")).otherwise(0)).alias("unique_keys"))
    met = each.select("file_id", "n", F.explode("files").alias("other")).where("file_id <> other").groupBy("file_id", "other").agg(F.sum("n").alias("shared"))
    best = met.withColumn("nth", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("shared"), "other"))).where("nth = 1")
    out = own.join(best.select("file_id", "other", "shared"), "file_id", "left")
    return out.select("file_id", "n_keys", "unique_keys", F.col("other").alias("best_cover"), F.round(F.coalesce(F.col("shared") / F.col("n_keys"), F.lit(0.0)), 4).alias("covered"), (F.coalesce("shared", F.lit(0)) == F.col("n_keys")).alias("residual_free"))


def merge_plan(members: DataFrame) -> DataFrame:
    """Plan of each cluster (cluster, file_id, n_rows, n_keys, key_column): rows in, bounds of rows out, most common key.

    An unknown number of keys is null and counts as neither bound.
    """
    return members.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum("n_rows").alias("rows_in"),
        F.max("n_keys").alias("least_out"),
        F.sum(F.coalesce("n_keys", "n_rows")).alias("most_out"),
        F.min_by("file_id", F.struct(-F.col("n_rows"), F.col("file_id"))).alias("canonical"),
        F.mode("key_column", True).alias("key_column"),
    )


def build_requirements(parts: list[tuple[DataFrame, str, int]], most: int = 40) -> DataFrame:
    """Numbered requirements from sources (table of requirement, evidence_expected, source, order; type; cap), in their order, ``most`` at the most."""
    made = []
    for i, (df, kind, cap) in enumerate(parts):
        top = df.orderBy("order", "requirement").limit(cap)
        made.append(top.select("requirement", "evidence_expected", "source", F.lit(kind).alias("type"), F.lit(i).alias("part"), "order"))
    every = made[0]
    for more in made[1:]:
        every = every.unionByName(more)
    # requirements are bounded by the caps
    nth = F.row_number().over(Window.orderBy("part", "order", "requirement"))
    return every.withColumn("nth", nth).where(F.col("nth") <= most).select(F.format_string("REQ-%03d", "nth").alias("requirement_id"), "requirement", "type", "source", "evidence_expected")


def file_rollup(sheets: DataFrame) -> DataFrame:
    """One row a file of (file_id, sheet, n_rows, n_columns, domain, score): sheets, rows, the widest sheet, the domain of the best score."""
    return sheets.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_sheets"),
        F.sum("n_rows").alias("n_rows"),
        F.max("n_columns").alias("n_columns"),
        F.min_by("domain", F.struct(-F.col("score"), F.col("sheet"))).alias("domain"),
    )


def resolve_products(wanted: DataFrame, products: DataFrame, edges: DataFrame, keywords: DataFrame) -> DataFrame:
    """(product, standard, how) of each wanted product: the first standard that a product of its name is linked to, else the first that its words find.

    products: (product_id, name). edges: (product_id, standard). keywords: (standard, word).
    """
    names = products.select("product_id", F.lower(F.trim("name")).alias("name"))
    linked = wanted.join(names, F.lower(F.trim("product")) == F.col("name")).join(edges, "product_id").groupBy("product").agg(F.min("standard").alias("linked"))
    words = wanted.select("product", F.explode(F.array_distinct(F.split(F.lower("product"), "[^a-z0-9]+"))).alias("word")).where("length(word) >= 3")
    hits = words.join(keywords, "word").groupBy("product", "standard").agg(F.count(F.lit(1)).alias("n"))
    found = hits.groupBy("product").agg(F.min_by("standard", F.struct(-F.col("n"), F.col("standard"))).alias("found"))
    out = wanted.join(linked, "product", "left").join(found, "product", "left")
    how = F.when(F.col("linked").isNotNull(), "LINKED").when(F.col("found").isNotNull(), "KEYWORD").otherwise("NOT_FOUND")
    return out.select("product", F.coalesce("linked", "found").alias("standard"), how.alias("how"))


def sections(rows: DataFrame, category: str, datasets: dict[str, list[str]]) -> DataFrame:
    """``rows`` with the ``dataset`` that their category belongs to; a category of none is left out, one of several is in each."""
    pairs = [(c, name) for name, categories in datasets.items() for c in categories]
    of = F.filter(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(n).alias("n")) for c, n in pairs]), lambda x: x["c"] == F.col(category))
    return rows.withColumn("dataset", F.explode(F.transform(of, lambda x: x["n"])))
