"""Operator 7, mixing sources to target weights by subset-sum budget fitting.

Each source's target is a share of all words by its weight, at most ``MAX_EPOCHS`` times its own
size. A source takes every document ``floor(target / size)`` times and once more those of a subset
whose words fill the remaining budget. The subset is found on the histogram of exact document
lengths, never on documents: a proportional part of every length, then the longest that fit, then a
bounded-knapsack table over the last ``TABLE_WORDS`` words. Which documents of a length are taken
once more follows a seeded hash of id and text, below a threshold for each source and length.

Defined results: a null or empty text has no words; very long texts are counted whole; a null source
is a source of its own, the last; a null ``doc_id`` is drawn by its text; repeated rows count once
each, and of those that tie at a threshold as many as are needed are taken; sources without words have
target 0; columns of any name stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import SPACE, bounded, nested, settled, table, text_or_empty, written

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = 7
#: Words of remaining budget that the knapsack table covers.
TABLE_WORDS = 1 << 15
#: Rows, on average at most, of a range of draws that is put in order.
PART_ROWS = 500


def n_words(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(f"[^{SPACE}]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size) of all sources.

    Water filling: sources above their limit get it, and the rest is shared by weight until none is
    above. Only the table of sources, a row each, is ordered in one task; sums of it reach the driver.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, len(weights)) + 1).cast("int")))
    weighted = written(weighted.withColumn("most", F.col("source_size") * max_epochs), "weights")
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    full, level = -1, 0.0
    while True:  # the level only rises, so each round has at least the full sources of the last
        capped = F.col("most") <= F.lit(level) * F.col("weight")
        n, taken, rest = weighted.agg(F.sum(capped.cast("long")), F.sum(F.when(capped, F.col("most"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if n is None or n == full or not rest:
            break
        full, level = n, (total - (taken or 0)) / rest
    return weighted.select("source", "source_size", F.least(F.col("most").cast("double"), F.lit(float(level)) * F.col("weight")).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest to ``budget`` from below."""
    took = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total <= 0:
        return took
    if budget >= total:
        return counts.astype(np.int64)
    took = (counts.astype(object) * budget // total).astype(np.int64)
    rest = budget - int((lengths * took).sum())
    for i in np.argsort(-lengths, kind="stable"):  # the longest first, down to what the table covers
        if rest <= TABLE_WORDS:
            break
        more = min(int(counts[i] - took[i]), (rest - TABLE_WORDS) // int(lengths[i])) if lengths[i] else 0
        took[i] += more
        rest -= more * int(lengths[i])
    # bounded knapsack: by_sum[w] is the part that first reached w words, parts are counts in powers of two
    by_sum = np.full(rest + 1, -1, np.int64)
    by_sum[0] = 0
    parts: list[tuple[int, int]] = [(0, 0)]
    for i in np.nonzero((lengths > 0) & (lengths <= rest) & (counts > took))[0]:
        left, k, length = int(min(counts[i] - took[i], rest // lengths[i])), 1, int(lengths[i])
        while left and by_sum[rest] < 0:
            k = min(k, left)
            step = k * length
            if step <= rest:
                new = (by_sum[:-step] >= 0) & (by_sum[step:] < 0)
                by_sum[step:][new] = len(parts)
                parts.append((int(i), k))
            left -= k
            k *= 2
        if by_sum[rest] >= 0:
            break
    at = int(np.nonzero(by_sum >= 0)[0][-1])
    while at:
        i, k = parts[by_sum[at]]
        took[i] += k
        at -= k * int(lengths[i])
    return took


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size")  # of equal sums the same is found again, whatever order rows come in
    lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    total, target = int((lengths * counts).sum()), float(pdf["target"].iloc[0])
    epochs = int(target // total) if total else 0
    extra = fit(lengths, counts, round(target) - epochs * total)
    return pd.DataFrame({"p_source": pdf["source"], "p_size": lengths, "source_size": pdf["source_size"], "target": target, "epochs": epochs, "extra": extra})


def _measured(source: str, text: str, seed: int) -> dict[str, Column]:
    """The columns that the mix goes by: source, size, and a draw that equal rows share."""
    return {"source": F.col(source).cast("string"), "size": n_words(text), "draw": F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col(text))}


def _planned(sizes: DataFrame) -> DataFrame:
    """(p_source, p_size, source_size, target, epochs, threshold, tied, take) of a table (source, size, draw) of all rows.

    A row is taken ``epochs`` times, and once more if its draw is below the threshold of its source and
    size. Of the ``tied`` rows at the threshold, ``take`` are. The threshold lies in one range of draws,
    found by counting; only that range's rows are put in order.
    """
    lengths = written(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    aims = written(targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))), "targets")
    # the table of sources has a row each and meets the histogram, not the documents
    aimed = lengths.join(aims, lengths["source"].eqNullSafe(aims["source"])).select(lengths["source"], "size", "n", "source_size", "target")
    fitted = written(aimed.groupBy("source").applyInPandas(_fit_source, "p_source string, p_size long, source_size long, target double, epochs long, extra long"), "fitted")
    same = F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size"))
    most = lengths.agg(F.max("n")).first()[0] or 1
    ranges = F.shiftright("draw", 64 - max(1, min(30, (most // PART_ROWS).bit_length())))
    wanted = bounded(fitted.where("extra > 0").select("p_source", "p_size", "extra"), 96)
    drawn = sizes.join(wanted, same).select("p_source", "p_size", "extra", "draw", ranges.alias("part"))
    counts = drawn.groupBy("p_source", "p_size", "extra", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("p_source", "p_size").orderBy("part")) - F.col("n")
    cuts = counts.withColumn("need", F.col("extra") - before).where("need BETWEEN 1 AND n")
    cuts = written(cuts.select(F.col("p_source").alias("c_source"), F.col("p_size").alias("c_size"), F.col("part").alias("c_part"), "need"), "cuts")
    near = drawn.join(bounded(cuts, 96), F.col("p_source").eqNullSafe(F.col("c_source")) & (F.col("p_size") == F.col("c_size")) & (F.col("part") == F.col("c_part")))
    group = Window.partitionBy("c_source", "c_size")
    ranked = near.withColumns({"nth": F.row_number().over(group.orderBy("draw")), "less": F.rank().over(group.orderBy("draw")) - 1, "tied": F.count(F.lit(1)).over(Window.partitionBy("c_source", "c_size", "draw"))})
    found = ranked.where("nth = need").select("c_source", "c_size", F.col("draw").alias("threshold"), "tied", (F.col("need") - F.col("less")).alias("take"))
    plan = fitted.join(found, F.col("p_source").eqNullSafe(F.col("c_source")) & (F.col("p_size") == F.col("c_size")), "left")
    return written(plan.drop("c_source", "c_size", "extra"), "plan")


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (source, size, draw and others) with what the plan says of them and ``times``."""
    joined = rows.join(bounded(plan, 128), F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")))
    split = F.coalesce((F.col("draw") == F.col("threshold")) & (F.col("take") < F.col("tied")), F.lit(False))
    once = F.coalesce(F.col("draw") <= F.col("threshold"), F.lit(False)).cast("long")
    plain = joined.where(~split).withColumn("times", F.col("epochs") + once)
    if plan.where("take < tied").isEmpty():
        return plain
    # rows that differ in nothing that was drawn by: some of them are taken
    nth = F.row_number().over(Window.partitionBy("source", "size", "draw").orderBy("draw"))
    some = joined.where(split).withColumn("nth", nth).withColumn("times", F.col("epochs") + (F.col("nth") <= F.col("take")).cast("long"))
    return plain.unionByName(some.drop("nth"))


@settled
def mix(docs: DataFrame, text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, times) of each row; ``taken`` counts repeats."""
    slim = docs.select("doc_id", *[c.alias(name) for name, c in _measured(source, text, seed).items()])
    slim = written(slim, "sizes")
    took = _taken(slim, _planned(slim))
    return took.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


@settled
def plan_of(docs: DataFrame, text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    return _planned(written(docs.select(*[c.alias(name) for name, c in _measured(source, text, seed).items()]), "sizes"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it is taken, rows taken no time left out.

    Rows without words have nothing to weigh and stay once. Texts aren't shuffled: each row is looked
    up in the plan by its source, size and draw.
    """
    took = _taken(nested(docs, **_measured(source, text, seed)), plan_of(docs, text, source, seed))
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("times")).cast("int")
    return took.withColumn("times", times).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
