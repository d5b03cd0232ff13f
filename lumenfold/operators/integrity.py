"""Keys, references, vocabularies, completeness and coverage, as rows that say what was found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import is_empty, is_placeholder
from lumenfold.operators.profile import cells
from lumenfold.storage import bounded


def key_check(df: DataFrame, table: str, key: str) -> DataFrame:
    """One row: rows, blank keys, rows that repeat a key, keys that repeat."""
    counted = df.groupBy(F.col(key).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    blank = is_empty(F.col("k"))
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).alias("blank_keys"),
        F.coalesce(F.sum(F.when(~blank, F.col("n") - 1)), F.lit(0)).alias("duplicate_rows"),
        F.count(F.when(~blank & (F.col("n") > 1), 1)).alias("repeated_keys"),
    ).select(F.lit(table).alias("table_name"), F.lit(key).alias("key_column"), "*")


def orphan_check(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """One row: how many child rows, and different keys, have no parent. Null keys refer to nothing."""
    keys = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    lost = keys.join(parent.select(F.col(parent_key).alias("k")), "k", "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"), F.count(F.lit(1)).alias("orphan_keys")).select(F.lit(name).alias("reference"), "*")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def completeness(df: DataFrame, table: str) -> DataFrame:
    """(table_name, column, n_rows, filled, percentage) of every column."""
    found = cells(df).groupBy("column").agg(F.count(F.lit(1)).alias("n_rows"), F.sum((~is_empty(F.col("value"))).cast("long")).alias("filled"))
    return found.select(F.lit(table).alias("table_name"), "column", "n_rows", "filled", F.round(100 * F.col("filled") / F.col("n_rows"), 2).alias("percentage"))


def vocabulary_check(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """(value, n) of values outside a controlled vocabulary."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(allowed)).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def placeholder_leaks(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, leaks) of columns that hold placeholders as if they were values."""
    return cells(df.select(*columns)).groupBy("column").agg(F.sum(is_placeholder(F.col("value")).cast("long")).alias("leaks"))


def coverage(left: DataFrame, right: DataFrame, key: str, left_name: str = "left", right_name: str = "right") -> DataFrame:
    """(status, n_keys): keys on both sides, or on one side only."""
    a = left.select(F.col(key).alias("k")).where("k IS NOT NULL").distinct().withColumn("a", F.lit(1))
    b = right.select(F.col(key).alias("k")).where("k IS NOT NULL").distinct().withColumn("b", F.lit(1))
    status = F.when(F.col("a").isNull(), f"{right_name}_only").when(F.col("b").isNull(), f"{left_name}_only").otherwise("both")
    return a.join(b, "k", "full_outer").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n_keys"))


def row_reconcile(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected against found row counts (table_name, n_rows), with a verdict a table."""
    joined = expected.withColumnRenamed("n_rows", "expected").join(found.withColumnRenamed("n_rows", "found"), "table_name", "full_outer")
    return joined.select("table_name", "expected", "found", F.coalesce(F.col("expected") == F.col("found"), F.lit(False)).alias("ok"))


def edge_stats(edges: DataFrame, kind: str, target: str) -> DataFrame:
    """(kind, n_edges, unresolved) of an edge table."""
    return edges.groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n_edges"), F.sum(F.col(target).isNull().cast("long")).alias("unresolved"))


def quarantine(edges: DataFrame, ends: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): edges whose ends are all there, and the others with the ends they lack."""
    lost = F.array_compact(F.array(*[F.when(is_empty(F.col(e)), F.lit(e)) for e in ends]))
    marked = edges.withColumn("missing_ends", F.array_join(lost, ","))
    return marked.where("missing_ends = ''").drop("missing_ends"), marked.where("missing_ends <> ''")


def repaired(bad: DataFrame, files: DataFrame, notes: DataFrame, sheets: DataFrame, labels: DataFrame, by_note: str) -> DataFrame:
    """Quarantined edges with the places and labels that other tables know; repairing them again changes nothing.

    bad: (quarantine_id, origin, evidence_value, source_file, source_file_id, source_sheet, source_row,
    resolved_id, resolved_label). A row number that a wrong split left in ``source_file_id`` goes to its
    place. Edges of origin ``by_note`` take file, sheet and resolved side from the note with their value
    and row: notes (evidence_value, row_no, resolved_id, file_id, sheet). Others take the sheet that
    their file and row have: sheets (file_id, row_no, sheet). files: (name, file_id). labels: (id, label).
    Of several facts for a key the least counts. An edge that nothing is known of keeps what it has.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    first = lambda df, keys, values: df.groupBy(*[F.col(c).cast("string").alias(f"__{c}") for c in keys]).agg(F.min(F.struct(*values)).alias("__x")).select(*[f"__{c}" for c in keys], *[F.col(f"__x.{v}").cast("string").alias(f"__{v}") for v in values])
    noted = F.col("origin") == by_note
    rows = bad.withColumn("__row", F.when(text("source_row") != "", text("source_row")).otherwise(text("source_file_id"))).withColumn("__value", text("evidence_value"))
    rows = rows.join(bounded(first(files, ["name"], ["file_id"]).withColumnRenamed("__file_id", "__named"), 128), text("source_file") == F.col("__name"), "left")
    facts = first(notes, ["evidence_value", "row_no"], ["resolved_id", "file_id", "sheet"]).withColumnRenamed("__row_no", "__note_row")
    rows = rows.join(bounded(facts, 256), noted & (F.col("__value") == F.col("__evidence_value")) & (F.col("__row") == F.col("__note_row")), "left").withColumnRenamed("__sheet", "__note_sheet")
    # a row number that stood for the file id is no file id
    moved = text("source_row") == ""
    old_id = F.when(moved, F.lit("")).otherwise(text("source_file_id"))
    known = lambda *c: F.coalesce(*[F.when(x != "", x) for x in c], F.lit(""))
    file_id = known(F.when(noted, F.coalesce("__file_id", F.lit(""))).otherwise(""), F.coalesce("__named", F.lit("")), old_id)
    rows = rows.withColumn("__at", file_id).join(bounded(first(sheets, ["file_id", "row_no"], ["sheet"]).select(F.col("__file_id").alias("__sf"), F.col("__row_no").alias("__sr"), "__sheet"), 128), ~noted & (F.col("__at") == F.col("__sf")) & (F.col("__row") == F.col("__sr")), "left")
    side = F.when(noted, known(F.coalesce("__resolved_id", F.lit("")), text("resolved_id"))).otherwise(text("resolved_id"))
    rows = rows.withColumn("__side", side).join(bounded(first(labels, ["id"], ["label"]), 256), F.col("__side") == F.col("__id"), "left")
    label = F.when(noted, known(F.coalesce("__label", F.lit("")), text("resolved_label"))).otherwise(known(text("resolved_label"), F.coalesce("__label", F.lit(""))))
    sheet = known(F.when(noted, F.coalesce("__note_sheet", F.lit(""))).otherwise(F.coalesce("__sheet", F.lit(""))), text("source_sheet"))
    new = {"source_file_id": F.col("__at"), "source_sheet": sheet, "source_row": F.col("__row"), "resolved_id": F.col("__side"), "resolved_label": label}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in bad.columns])
