"""Integration of sources: column mapping, ids, field merges, conflicts, edges, provenance, chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import is_empty, punctuation_free, squeeze
from lumenfold.storage import bounded, written


def resolve_columns(columns: DataFrame, overrides: DataFrame, scoped: DataFrame, common: DataFrame) -> DataFrame:
    """Map source columns (file_id, entity, column) to canonical ones: file override, then entity, then common map.

    An unknown column is kept as an attribute of its own name.
    """
    out = (
        columns.join(bounded(overrides.select("file_id", "column", F.col("target").alias("t1")), 256), ["file_id", "column"], "left")
        .join(bounded(scoped.select("entity", "column", F.col("target").alias("t2")), 256), ["entity", "column"], "left")
        .join(bounded(common.select("column", F.col("target").alias("t3")), 256), "column", "left")
    )
    tier = F.when(F.col("t1").isNotNull(), "FILE_OVERRIDE").when(F.col("t2").isNotNull(), "ENTITY_SCOPED").when(F.col("t3").isNotNull(), "COMMON").otherwise("ATTRIBUTE")
    return out.select("file_id", "entity", "column", F.coalesce("t1", "t2", "t3", "column").alias("target"), tier.alias("tier"))


def natural_key(candidates: list[list[Column]], position: Column) -> Column:
    """Struct (key, flag): the first candidate whose parts are all filled, else the position, flagged."""
    whole = [(reduce(lambda a, b: a & b, [~is_empty(p) for p in parts]), F.concat_ws("|", *[F.lower(squeeze(p)) for p in parts])) for parts in candidates]
    key = reduce(lambda w, c: w.when(c[0], c[1]), whole, F.when(F.lit(False), F.lit("")))
    found = reduce(lambda a, b: a | b, [c[0] for c in whole])
    return F.struct(key.otherwise(position).alias("key"), F.when(found, "").otherwise("NO_NATURAL_KEY").alias("flag"))


def mint_ids(keys: DataFrame, key: str, prefix: str, width: int = 5) -> DataFrame:
    """(key, id) for the distinct filled keys, numbered from 1 in code-point order.

    Keys are dealt by range; each range is numbered alone and shifted by the sizes of those before it,
    so numbering needs no single task.
    """
    distinct = keys.select(F.lower(squeeze(F.col(key))).alias("key")).where("key <> ''").distinct()
    # written, so that what a range is doesn't change between its two uses
    ranged = written(distinct.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "keys")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("before"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("key"))
    numbered = ranged.withColumn("nth", nth).join(F.broadcast(starts), "part")
    number = (F.col("before") + F.col("nth")).cast("string")
    return numbered.select("key", F.concat(F.lit(f"{prefix}-"), F.when(F.length(number) >= width, number).otherwise(F.lpad(number, width, "0"))).alias("id"))


def merge_field(contributions: DataFrame, by: list[str], order: list[str], policy: str) -> DataFrame:
    """Merge the values of one field (by..., value, order...) by a policy; ``conflicts`` counts different values that lost.

    Values with the same punctuation-free form are one; the first of them stands. Policies: LONGEST,
    COALESCE (the first), APPEND_DISTINCT (joined by `` | ``), KEY_IDENTITY (the first, others conflict).
    """
    filled = contributions.where(~is_empty(F.col("value")))
    form = filled.withColumn("form", punctuation_free(F.col("value")))
    at = F.struct(*order, "value")
    distinct = form.groupBy(*by, "form").agg(F.min(at).alias("at"), F.count(F.lit(1)).alias("n")).withColumn("value", F.col("at.value"))
    n = F.count(F.lit(1))
    if policy == "LONGEST":
        # of equal lengths the first
        ranked = F.min_by("value", F.struct(-F.length("value"), "at"))
        merged, lost = ranked, F.lit(0)
    elif policy == "APPEND_DISTINCT":
        rows = F.array_sort(F.collect_list(F.struct("at")))
        merged, lost = F.array_join(F.transform(rows, lambda r: r["at"]["value"]), " | "), F.lit(0)
    elif policy in ("COALESCE", "KEY_IDENTITY"):
        merged, lost = F.min_by("value", "at"), (n - 1 if policy == "KEY_IDENTITY" else F.lit(0))
    else:
        raise ValueError(f"unknown policy {policy!r}")
    return distinct.groupBy(*by).agg(merged.alias("value"), n.alias("distinct_values"), F.sum("n").alias("contributions"), lost.cast("long").alias("conflicts"))


def explode_edges(df: DataFrame, source: str, members: Column) -> DataFrame:
    """(source_id, member): one edge for each different member of a list column."""
    each = df.select(F.col(source).alias("source_id"), F.explode(F.array_distinct(members)).alias("member"))
    return each.where(~is_empty(F.col("member")))


def resolve_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges (source_id, member) with target_id from (key, id); unmatched ones get confidence 0.6 and a review flag."""
    keyed = edges.withColumn("key", F.lower(squeeze(F.col("member"))))
    out = keyed.join(ids.withColumnRenamed("id", "target_id"), "key", "left")
    lost = F.col("target_id").isNull()
    return out.select("source_id", "member", "target_id", F.when(lost, 0.6).otherwise(1.0).alias("confidence"), lost.alias("review"))


def disposition(merged: Column, conflict: Column, review: Column, covered: Column) -> Column:
    """What became of a source row; the last rule that holds wins, a row of a covered file is archived."""
    return F.when(covered, "DUPLICATE_ARCHIVED").when(review, "REQUIRES_REVIEW").when(conflict, "CONFLICT_PRESERVED").when(merged, "MERGED").otherwise("CANONICAL")


def provenance(df: DataFrame, entity_id: str, file_id: str, row_no: str, columns: list[str]) -> DataFrame:
    """(entity_id, column, source_file_id, source_row, raw_value): one row a filled source cell."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("raw_value")) for c in columns])).alias("x")
    long = df.select(F.col(entity_id).alias("entity_id"), F.col(file_id).alias("source_file_id"), F.col(row_no).alias("source_row"), each)
    return long.select("entity_id", "x.column", "source_file_id", "source_row", "x.raw_value").where(~is_empty(F.col("raw_value")))


def provenance_gap(masters: DataFrame, recorded: DataFrame, key: str = "entity_id") -> DataFrame:
    """One row: masters, and masters without and with provenance."""
    left = masters.select(F.col(key).alias("k")).distinct()
    has = left.join(recorded.select(F.col(key).alias("k"), F.lit(1).alias("has")).distinct(), "k", "left")
    return has.agg(F.count(F.lit(1)).alias("masters"), F.count("has").alias("covered"), F.count(F.when(F.col("has").isNull(), 1)).alias("uncovered"))


def audit_tail(rows: DataFrame, by: str, file_id: str, row_no: str, most: int = 200) -> DataFrame:
    """(by, source_count, source_files, source_rows): where a master comes from; the first ``most`` rows are listed."""
    counted = rows.groupBy(by).agg(F.count(F.lit(1)).alias("source_count"), F.array_join(F.array_sort(F.collect_set(file_id)), "; ").alias("source_files"))
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(file_id, row_no))).where(F.col("nth") <= most)
    listed = ranked.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.col(row_no).cast("string").alias("r")))), lambda x: x["r"]).alias("r"))
    return counted.join(listed, by).select(by, "source_count", "source_files", F.array_join("r", "; ").alias("source_rows"))


def joined_list(values: Column, total: Column, chars: int = 8000) -> Column:
    """Sorted values joined by `` | `` up to ``chars`` characters, with a note of how many of ``total`` aren't shown."""
    zero = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(acc: Column, v: Column) -> Column:
        longer = F.when(acc["n"] == 0, v).otherwise(F.concat(acc["s"], F.lit(" | "), v))
        full = acc["full"] | (F.length(longer) > chars)
        return F.struct(F.when(full, acc["s"]).otherwise(longer).alias("s"), F.when(full, acc["n"]).otherwise(acc["n"] + 1).alias("n"), full.alias("full"))

    more = lambda acc: F.when(total > acc["n"], F.concat(acc["s"], F.lit(" | +"), (total - acc["n"]).cast("string"), F.lit(" more"))).otherwise(acc["s"])
    return F.aggregate(F.array_sort(values), zero, step, more)


def chunk_rows(df: DataFrame, id_column: str, fields: list[str], least: int = 40) -> DataFrame:
    """(chunk_id, content, sha256): rows as ``field: value; ...`` of their filled fields; shorter contents are dropped."""
    parts = [F.when(~is_empty(F.col(f)), F.concat(F.lit(f"{f}: "), squeeze(F.col(f)))) for f in fields]
    content = F.concat_ws("; ", *parts)
    out = df.select(F.concat(F.lit("CH-"), F.col(id_column).cast("string")).alias("chunk_id"), content.alias("content")).where(F.length("content") >= least)
    return out.withColumn("sha256", F.sha2("content", 256))


def attributes(df: DataFrame, entity_id: str, columns: list[str]) -> DataFrame:
    """(entity_id, attribute, value) of the filled columns."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), squeeze(F.col(c)).alias("value")) for c in columns])).alias("x")
    return df.select(F.col(entity_id).alias("entity_id"), each).select("entity_id", "x.*").where("value <> ''")


def with_aspects(masters: DataFrame, key: str, aspects: dict[str, tuple[DataFrame, str, str]], chars: int | None = 8000) -> DataFrame:
    """Masters with a count and a list for each aspect: an edge table with its key and value columns.

    Of a master's values only as many are collected as the list can show; all of them where ``chars`` is None.
    """
    out = masters
    for name, (edges, edge_key, shown) in aspects.items():
        each = edges.select(F.col(edge_key).alias(key), F.col(shown).cast("string").alias("v")).where("v IS NOT NULL").distinct()
        if chars is None:
            side = each.groupBy(key).agg(F.count(F.lit(1)).alias(f"{name}_count"), F.array_join(F.array_sort(F.collect_list("v")), " | ").alias(f"{name}_list"))
            out = out.join(side, key, "left").na.fill({f"{name}_count": 0, f"{name}_list": ""})
            continue
        counts = each.groupBy(key).agg(F.count(F.lit(1)).alias(f"{name}_count"))
        nth = F.row_number().over(Window.partitionBy(key).orderBy("v"))
        first = each.withColumn("nth", nth).where(F.col("nth") <= chars // 4 + 2).groupBy(key).agg(F.collect_list("v").alias("vs"))
        side = counts.join(first, key).select(key, f"{name}_count", joined_list(F.col("vs"), F.col(f"{name}_count"), chars).alias(f"{name}_list"))
        out = out.join(side, key, "left").na.fill({f"{name}_count": 0, f"{name}_list": ""})
    return out


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, one a key, and those of ``existing`` that it doesn't replace."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new.dropDuplicates([key]))


def point_id(c: Column, namespace: str = "lumenfold:") -> Column:
    """A name-based UUID (version 5 layout) of an id, from the SHA-1 of the URL namespace and the name."""
    url_namespace = F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8"))
    h = F.sha1(F.concat(url_namespace, F.concat(F.lit(namespace), c).cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63)).bitwiseOR(128)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def running_ids(df: DataFrame, order: list[str], prefix: str, width: int = 6, after: int = 0) -> DataFrame:
    """``df`` with ``seq_no`` and ``seq_id``: rows numbered by ``order`` from ``after`` + 1 on.

    A later slice of the rows goes on where the one before ended, if its ``after`` is how many were
    numbered. Rows are dealt by range, numbered within it and shifted by what lies before, so no task
    has them all. Rows equal in ``order`` get their numbers in any order; nulls come first.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))  # a row a range
    numbered = ranged.withColumn("__nth", F.row_number().over(Window.partitionBy("__part").orderBy(*order))).join(F.broadcast(starts), "__part")
    number = F.col("__before") + F.col("__nth") + after
    text = number.cast("string")
    padded = F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))
    return numbered.select(*df.columns, number.alias("seq_no"), F.concat(F.lit(f"{prefix}-"), padded).alias("seq_id"))


def expand_fields(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """(columns of ``df``, fields, review, original, label): the fields of a struct column as a map of canonical names.

    names: what each field becomes; ``{}`` stands for the column's name, and ``@review``, ``@original`` and
    ``@label`` go to columns of their own, ``@drop`` nowhere. A field without a name is ``column_field``.
    Empty fields are left out.
    """
    parts = [f.name for f in df.schema[column].dataType.fields]
    text = {p: squeeze(F.col(f"`{column}`.`{p}`")) for p in parts}
    sentinel = {s: next((text[p] for p in parts if names.get(p) == s), F.lit("")) for s in ("@review", "@original", "@label")}
    own = [(names[p].replace("{}", column) if p in names else f"{column}_{p}", text[p]) for p in parts if not names.get(p, "").startswith("@")]
    pairs = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in own]), lambda x: x["value"] != "")
    return df.withColumns({"fields": F.map_from_entries(pairs), "review": sentinel["@review"], "original": sentinel["@original"], "label": sentinel["@label"]})


def registered(files: DataFrame, tabular: DataFrame, after: int = 0) -> DataFrame:
    """Registry rows of the files that no row was read from, numbered by file id from ``after`` + 1 on.

    files: an inventory (file_id, name, path, extension, bytes, modified, sha256, parser_status). tabular:
    (file_id) of the files with rows. Columns: document_id, document_type, title, local_path, sha256,
    bytes, last_modified, parser_status, source_file_id, source_file, filled, completeness.
    """
    others = files.join(bounded(tabular.select("file_id").distinct(), 32), "file_id", "left_anti")
    numbered = running_ids(others, ["file_id", "path"], "DOC", 5, after)
    made = numbered.select(
        F.col("seq_id").alias("document_id"), F.upper(F.coalesce("extension", F.lit(""))).alias("document_type"), F.regexp_replace("name", "\\.[^.]*$", "").alias("title"), F.col("path").alias("local_path"), "sha256", "bytes", F.col("modified").alias("last_modified"), "parser_status",
        F.col("file_id").alias("source_file_id"), F.col("name").alias("source_file"),
    )
    filled = sum((F.when(~is_empty(F.col(c)), 1).otherwise(0) for c in made.columns), F.lit(0))
    return made.withColumn("filled", filled).withColumn("completeness", F.round(100.0 * F.col("filled") / len(made.columns), 1))
