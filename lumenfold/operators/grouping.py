"""Groups, version chains, coverage and merge steps of datasets, from the verdicts of their pairs.

Pairs have a row each: file_a, file_b, decision, and, where a function says so, newer (A, B or empty),
unique_a and unique_b (keys that one side alone has), lost_a and lost_b (columns that one side alone has),
conflicts, common_keys, archived, key_column, identity. Files have a row each: file_id, n_rows, target.
Neither holds rows of data. Each round of a loop is a written table, so plans stay short.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.storage import bounded, met, settled, written

# Decisions, and what becomes of a file.
COPIES = ["EXACT_DUPLICATE", "IDENTICAL_CONTENT"]
VERSIONS = ["VERSION_NEWER", "VERSION_OLDER"]
ALIKE = [*COPIES, *VERSIONS, "LIKELY_DUPLICATE", "DUPLICATE_WITH_UNIQUE_DATA"]
COLLAPSING = ["DUPLICATE_WITH_UNIQUE_DATA", "COMPLEMENTARY", "LIKELY_DUPLICATE"]
REKEYED = "SAME_ENTITIES_DIFFERENT_KEY_NAMESPACE"


def _both(pairs: DataFrame, *more: str) -> DataFrame:
    """Each pair from both its ends: file, other, and more columns; a column ending in ``_a`` or ``_b`` as seen from the file."""
    turn = lambda c: c[:-1] + ("b" if c.endswith("a") else "a") if c.endswith(("_a", "_b")) else c
    ahead = pairs.select(F.col("file_a").alias("file"), F.col("file_b").alias("other"), *more)
    return ahead.unionByName(pairs.select(F.col("file_b").alias("file"), F.col("file_a").alias("other"), *[F.col(turn(c)).alias(c) for c in more]))


def _jumped(parents: DataFrame) -> DataFrame:
    """(node, top) of (node, parent) in a forest; each round halves what is left of all paths."""
    held = written(parents.select("node", F.col("parent").alias("top"), F.lit(True).alias("moved")), "tops")
    while not held.where("moved").isEmpty():
        above = bounded(held.select(F.col("node").alias("top"), F.col("top").alias("higher")), 128)
        held = written(held.join(above, "top", "left").select("node", F.coalesce("higher", "top").alias("top"), F.col("higher").isNotNull().alias("moved")), "tops")
    return held.drop("moved")


@settled
def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (two columns); root is the smallest node that links lead to.

    Each round every node goes under its smallest neighbour, if that is smaller, and trees become single
    nodes; what is left are fewer nodes, until no link is left. Null ends are no links.
    """
    a, b = links.columns
    edges = written(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct(), "links")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    held = written(nodes.select("node", F.col("node").alias("root")), "roots")
    edges = edges.where("a <> b")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        under = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")).where("parent < node")
        tops = bounded(_jumped(under), 128)
        up = lambda df, c: df.join(tops.select(F.col("node").alias(c), "top"), c, "left").withColumn(c, F.coalesce("top", c)).drop("top")  # noqa: E731, B023
        held = written(up(held, "root"), "roots")
        edges = written(up(up(edges, "a"), "b").where("a <> b").select("a", "b").distinct(), "links")
    return held.select("node", "root")


def dataset_groups(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """(file_id, group_id, n_files, canonical) of every file.

    A group is joined by decisions that say that files hold the same records (``ALIKE``), and has the
    name of its least file; its canonical file is the newest revision of most rows, then of the least name.
    """
    alike = pairs.where(F.col("decision").isin(ALIKE))
    grouped = files.select("file_id", "n_rows").join(bounded(components(alike.select("file_a", "file_b")), 128), F.col("file_id") == F.col("node"), "left")
    old = newer_edges(pairs).select(F.col("older").alias("file_id")).distinct().withColumn("old", F.lit(True))
    rows = grouped.join(bounded(old, 64), "file_id", "left").select("file_id", F.coalesce("root", "file_id").alias("group_id"), F.struct(F.coalesce("old", F.lit(False)).alias("old"), (-F.col("n_rows")).alias("rows"), "file_id").alias("order"))
    groups = rows.groupBy("group_id").agg(F.count("*").alias("n_files"), F.min("order")["file_id"].alias("canonical"))
    return rows.select("file_id", "group_id").join(bounded(groups, 128), "group_id")


def newer_edges(pairs: DataFrame) -> DataFrame:
    """(older, newer) of the pairs of which one side is a later version."""
    of = pairs.where(F.col("decision").isin(VERSIONS))
    later = F.col("decision") == "VERSION_NEWER"
    return of.select(F.when(later, F.col("file_a")).otherwise(F.col("file_b")).alias("older"), F.when(later, F.col("file_b")).otherwise(F.col("file_a")).alias("newer")).distinct()


@settled
def version_chains(pairs: DataFrame) -> DataFrame:
    """(file_id, chain_id, position, length, latest, status) of the files that have a version order.

    Position is the number of versions on the longest way from an oldest file, from 0; latest marks the
    files of which no newer one is known. Files on a circle of newer edges, or between two circles, have
    no position and the status CYCLE; files that only come after a circle have none either and are
    AFTER_CYCLE. A round of peeling takes off one version, so there are as many rounds as versions.
    """
    edges = written(newer_edges(pairs), "newer")
    nodes = edges.select(F.col("older").alias("file_id")).union(edges.select("newer")).distinct()
    left, done, level = edges, [], 0
    remaining = written(nodes, "remaining")
    while True:  # from the oldest up
        ready = written(remaining.join(bounded(left.select(F.col("newer").alias("file_id")).distinct(), 64), "file_id", "left_anti"), "ready")
        if ready.isEmpty():
            break
        done.append(ready.select("file_id", F.lit(level).alias("position"), F.lit("ORDERED").alias("status")))
        remaining = written(remaining.join(bounded(ready, 64), "file_id", "left_anti"), "remaining")
        left = written(left.join(bounded(ready.select(F.col("file_id").alias("older")), 64), "older", "left_anti"), "newer")
        level += 1
    while True:  # what is left of no way back into a circle comes after one
        last = written(remaining.join(bounded(left.select(F.col("older").alias("file_id")).distinct(), 64), "file_id", "left_anti"), "last")
        if last.isEmpty():
            break
        done.append(last.select("file_id", F.lit(None).cast("int").alias("position"), F.lit("AFTER_CYCLE").alias("status")))
        remaining = written(remaining.join(bounded(last, 64), "file_id", "left_anti"), "remaining")
        left = written(left.join(bounded(last.select(F.col("file_id").alias("newer")), 64), "newer", "left_anti"), "newer")
    done.append(remaining.select("file_id", F.lit(None).cast("int").alias("position"), F.lit("CYCLE").alias("status")))
    placed = reduce(DataFrame.unionByName, done)
    chains = components(edges).select(F.col("node").alias("file_id"), F.col("root").alias("chain_id"))
    old = edges.select(F.col("older").alias("file_id")).distinct().withColumn("old", F.lit(True))
    out = placed.join(bounded(chains, 128), "file_id").join(bounded(old, 64), "file_id", "left")
    length = F.max("position").over(Window.partitionBy("chain_id")) + 1
    return out.select("file_id", "chain_id", "position", length.alias("length"), (F.col("old").isNull() & (F.col("status") == "ORDERED")).alias("latest"), "status")


def covers(pairs: DataFrame) -> DataFrame:
    """(file, by): each file and one that holds all of it: its copy, or its newer version if that has all its columns."""
    copies = pairs.where(F.col("decision").isin(COPIES)).select(F.col("file_b").alias("file"), F.col("file_a").alias("by"))
    later = F.col("decision") == "VERSION_NEWER"
    lost = F.when(later, F.col("lost_a")).otherwise(F.col("lost_b"))
    newer = pairs.where(F.col("decision").isin(VERSIONS) & (lost == 0))
    return copies.unionByName(newer.select(F.when(later, F.col("file_a")).otherwise(F.col("file_b")).alias("file"), F.when(later, F.col("file_b")).otherwise(F.col("file_a")).alias("by"))).distinct()


def canonical_files(files: DataFrame, pairs: DataFrame, shown: int = 6) -> DataFrame:
    """What becomes of each file: (file_id, n_pairs, status, covered_by, unique_to, most_unique, residual, conflicts, archive).

    A file may be archived only if another holds all of it and, for each third file to which it adds
    keys, a file that covers it adds as many. ``residual`` are the third files for which that isn't
    shown. ``covered_by``, ``unique_to`` and ``residual`` are names joined by ``; ``, the last two cut
    after ``shown``.
    """
    ends = _both(pairs, "unique_a", "conflicts", "decision")
    adds = ends.where("unique_a > 0").groupBy("file", "other").agg(F.max("unique_a").alias("n"))
    by = covers(pairs)
    # what a covering file adds to the same third file
    shown_there = adds.join(by, "file").join(adds.select(F.col("file").alias("by"), "other", F.col("n").alias("also")), ["by", "other"]).where("also >= n AND by <> other").select("file", "other").distinct()
    held = by.select("file", F.col("by").alias("other"))
    open_ = adds.join(shown_there, ["file", "other"], "left_anti").unionByName(adds.join(held, ["file", "other"], "left_semi")).distinct()
    cut = lambda c: F.concat(F.array_join(F.slice(c, 1, shown), "; "), F.when(F.size(c) > shown, F.concat(F.lit("; +"), (F.size(c) - shown).cast("string"), F.lit(" more"))).otherwise(""))
    names = lambda df, c, name: df.groupBy("file").agg(F.array_sort(F.collect_set(c)).alias(name))
    facts = ends.groupBy("file").agg(F.count("*").alias("n_pairs"), F.sum("conflicts").alias("conflicts"), F.max((F.col("decision") == "DIFFERENT_ENTITY").cast("int")).alias("distinct"))
    most = adds.groupBy("file").agg(F.max("n").alias("most"))
    out = files.select(F.col("file_id").alias("file"))
    for part in (facts, most, names(by, "by", "covered"), names(adds, "other", "adds"), names(open_, "other", "open")):
        out = out.join(bounded(part, 256), "file", "left")
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    status = (
        F.when(F.col("n_pairs").isNull(), "KEEP_AS_CANONICAL_UNIQUE")
        .when(some("covered") & ~some("open"), "REDUNDANT_ARCHIVE_AFTER_VALIDATION")
        .when(some("covered"), "KEEP_CONTAINS_UNIQUE_RECORDS_ELSEWHERE")
        .when(F.col("distinct") > 0, "KEEP_DISTINCT_ENTITY")
        .when(some("adds"), "KEEP_AND_MERGE_CONTRIBUTES_UNIQUE_RECORDS")
        .otherwise("KEEP_PENDING_REVIEW")
    )
    text = lambda c: F.coalesce(c, F.lit(""))
    return out.select(
        F.col("file").alias("file_id"), F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), status.alias("status"), text(F.array_join("covered", "; ")).alias("covered_by"), text(cut(F.col("adds"))).alias("unique_to"),
        F.coalesce("most", F.lit(0)).alias("most_unique"), text(cut(F.col("open"))).alias("residual"), F.coalesce("conflicts", F.lit(0)).alias("conflicts"), (status == "REDUNDANT_ARCHIVE_AFTER_VALIDATION").alias("archive"),
    )


def merge_steps(files: DataFrame, pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """A step for each target of the files that ``kept`` (``canonical_files``) doesn't archive.

    (step_id, target, n_files, join_key, key_status, rows_in, least_out, most_out, added, collapsed,
    conflicts, splits, decisions, approval): bounds of the rows out, the least if every measured
    duplicate collapses. Only pairs within a target count.
    """
    own = files.join(bounded(kept.where("NOT archive").select("file_id"), 64), "file_id", "left_semi").select("file_id", "n_rows", F.coalesce("target", F.lit("unclassified")).alias("target"))
    steps = own.groupBy("target").agg(F.count("*").alias("n_files"), F.sum("n_rows").alias("rows_in"), F.max("n_rows").alias("largest"))
    at = lambda c, t: bounded(own.select(F.col("file_id").alias(c), F.col("target").alias(t)), 128)
    inside = pairs.join(at("file_a", "target"), "file_a").join(at("file_b", "__t"), "file_b").where("target = __t")
    collapse = F.col("archived") + F.when(F.col("decision").isin(COLLAPSING), F.greatest("common_keys", F.lit(0))).otherwise(0)
    sums = inside.groupBy("target").agg(
        F.sum(collapse).alias("collapse"), F.sum("conflicts").alias("conflicts"), F.mode("key_column", True).alias("join_key"), F.max((F.col("identity") == REKEYED).cast("int")).alias("rekey"), F.sum((F.col("decision") == "DIFFERENT_ENTITY").cast("long")).alias("splits"),
    )
    each = inside.groupBy("target", "decision").agg(F.count("*").alias("n"))
    listed = each.groupBy("target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("decision", "n"))), lambda x: F.concat(x["decision"], F.lit("="), x["n"].cast("string"))), "; ").alias("decisions"))
    out = steps.join(bounded(sums, 256), "target", "left").join(bounded(listed, 1024), "target", "left").na.fill({"collapse": 0, "conflicts": 0, "rekey": 0, "splits": 0, "decisions": ""})
    least = F.greatest(F.col("largest"), F.col("rows_in") - F.col("collapse"))
    key: Column = F.when(F.col("rekey") > 0, "REKEY_REQUIRED").when(F.col("join_key").isNotNull(), "MEASURED_SHARED_KEY").otherwise("NO_SHARED_KEY")
    nth = F.row_number().over(Window.orderBy("target"))  # a row a target, each with its files counted
    return out.select(
        F.format_string("MS-%02d", nth).alias("step_id"), "target", "n_files", F.coalesce("join_key", F.lit("")).alias("join_key"), key.alias("key_status"), "rows_in", least.alias("least_out"), F.col("rows_in").alias("most_out"), (least - F.col("largest")).alias("added"),
        F.least("collapse", F.col("rows_in") - F.col("largest")).alias("collapsed"), "conflicts", "splits", "decisions", ((F.col("rekey") > 0) | (F.col("splits") > 0) | (F.col("conflicts") > 0)).alias("approval"),
    )


@settled
def cover_sets(keys: DataFrame) -> DataFrame:
    """(file_id, n_keys, covered_by, residual) of each file of (file_id, key): other files that together hold its keys.

    Chosen greedily: in each round the file that holds most of what is left, of ties the least. Keys are
    counted by the set of files that hold them; ``residual`` are those that no other file has. There are
    as many rounds as the largest cover has files. Null keys are none.
    """
    sets = keys.where("key IS NOT NULL").distinct().groupBy("key").agg(F.array_sort(F.collect_set("file_id")).alias("files"))
    counts = sets.groupBy("files").agg(F.count("*").alias("n"))
    every = written(counts.select(F.explode("files").alias("file_id"), "files", "n"), "signatures")
    own = every.groupBy("file_id").agg(F.sum("n").alias("n_keys"), F.sum(F.when(F.size("files") == 1, F.col("n")).otherwise(0)).alias("residual"))
    left, chosen, nth = every.where("size(files) > 1"), [], 0
    while True:
        gain = left.select("file_id", "n", F.explode("files").alias("by")).where("by <> file_id").groupBy("file_id", "by").agg(F.sum("n").alias("gain"))
        best = written(gain.groupBy("file_id").agg(F.min(F.struct((-F.col("gain")).alias("order"), "by"))["by"].alias("by"), F.count("*").alias("n")), "best")
        if best.isEmpty():
            break
        chosen.append(best.select("file_id", F.struct(F.lit(nth).alias("nth"), "by").alias("x")))
        sizes = left.groupBy("file_id").agg(F.count("*").alias("n"))
        facts = written(best.drop("n").join(sizes, "file_id"), "chosen")
        left = written(met(left.withColumnRenamed("n", "held"), facts, "file_id").where(~F.array_contains("files", F.col("by"))).select("file_id", "files", F.col("held").alias("n")), "signatures")
        nth += 1
    if not chosen:
        return own.select("file_id", "n_keys", F.lit("").alias("covered_by"), "residual")
    listed = reduce(DataFrame.union, chosen).groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["by"].cast("string")), "; ").alias("covered_by"))
    return own.join(listed, "file_id", "left").na.fill({"covered_by": ""}).select("file_id", "n_keys", "covered_by", "residual")
