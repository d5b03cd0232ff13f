"""Operator 6, quality classifier: a sparse rule ensemble over text statistics.

Boosted shallow trees are fitted to labelled rows; each path from a root to a node is a conjunctive
rule. A logistic model with lasso weights keeps few of them. The kept rules become one Spark column
expression over the statistics, so scoring is a projection.

Training uses at most ``MAX_TRAIN`` labelled rows, those with the least hash of their ``doc_id``.

Defined results: null and empty texts have statistics of zero and a score as any other; rows whose
labels differ are used with each; with no labelled row, or labels of one class only, the score is
constant; very long texts are measured whole; equal gains go to the first statistic and threshold;
repeated rows are scored each; columns of any name are kept, but those named as statistics or results
are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add, eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import bounded, drop_clashing, nested, row_schema, table

MAX_TRAIN = 20_000
TREES, DEPTH, BINS, RATE = 24, 3, 32, 0.3
LASSO = 0.002
THRESHOLD = 0.7
#: Distinct words are counted in blocks, so that their share doesn't fall with a text's length.
BLOCK_WORDS = 200
STATISTICS = [
    "mean_word", "symbol_share", "pipe_share", "bang_share", "upper_share", "stop_share",
    "comma_share", "distinct_share", "repeat_share", "line_words", "letter_share", "long_share",
]

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))


def statistics(text: bytes | None) -> list[float]:
    """The statistics of a text of UTF-8, in the order of ``STATISTICS``; shares are of its bytes or words."""
    b = text or b""
    words = b.split()
    n, size = max(1, len(words)), max(1, len(b))

    def share(chars: bytes) -> float:
        return (len(b) - len(b.translate(None, chars))) / size

    letters = share(_LETTERS)
    return [
        sum(map(len, words)) / n,
        share(b"#*$%&<>"),
        share(b"|"),
        share(b"!"),
        share(bytes(range(65, 91))) / max(letters, 1e-9),
        share(b".?"),
        share(b",;:"),
        sum(len(set(words[i : i + BLOCK_WORDS])) for i in range(0, len(words), BLOCK_WORDS)) / n,
        sum(map(eq, words, words[1:])) / n,
        len(words) / (b.count(b"\n") + 1),
        letters,
        sum(map((20).__lt__, map(len, words))) / n,
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t) for t in batch.column(1).to_pylist()]
        columns = np.array(rows, np.float64).reshape(len(rows), len(STATISTICS))
        yield pa.record_batch([batch.column(0), *(pa.array(columns[:, i]) for i in range(len(STATISTICS)))], names=["row", *STATISTICS])


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the statistics of each row."""
    docs = drop_clashing(docs, STATISTICS)
    slim = nested(docs, text, bytes=F.col(text).cast("binary"))
    return slim.mapInArrow(_measure, row_schema(slim, ", ".join(f"{s} double" for s in STATISTICS))).select("row.*", *STATISTICS)


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, whether above, threshold), ascending


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """Rules of boosted trees with logistic loss; splits are at quantiles of the statistics."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    margin, rules = np.full(len(y), 0.0), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        nodes: list[tuple[np.ndarray, Rule]] = [(np.arange(len(y)), ())]
        for level in range(depth):
            below = []
            for rows, path in nodes:
                best = (1e-3, None)
                total_g, total_h = g[rows].sum(), h[rows].sum()
                for j in range(x.shape[1]):
                    if not len(cuts[j]):
                        continue
                    sg = np.cumsum(np.bincount(bins[rows, j], g[rows], len(cuts[j]) + 1))[:-1]
                    sh = np.cumsum(np.bincount(bins[rows, j], h[rows], len(cuts[j]) + 1))[:-1]
                    gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
                    at = int(np.argmax(gain))
                    if gain[at] > best[0]:
                        best = (gain[at], (j, at))
                if best[1] is None:
                    margin[rows] += RATE * total_g / (total_h + 1)
                    continue
                j, at = best[1]
                high = bins[rows, j] > at
                for above in (False, True):
                    part, rule = rows[high == above], (*path, (j, above, float(cuts[j][at])))
                    rules[tuple(sorted(set(rule)))] = True
                    below.append((part, rule))
            nodes = below
        for rows, _ in nodes:
            margin[rows] += RATE * g[rows].sum() / (h[rows].sum() + 1)
    return list(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, j] > cut) if above else (x[:, j] <= cut) for j, above, cut in rule])


def lasso(r: np.ndarray, y: np.ndarray, penalty: float = LASSO, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of the logistic loss plus ``penalty`` times the weights' sizes, by accelerated proximal steps."""
    n, m = r.shape
    v = np.ones(m) / max(1, m) ** 0.5
    for _ in range(20):  # the largest curvature of the loss
        v = r.T @ (r @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (np.linalg.norm(r @ v) ** 2 / (4 * n) + 0.25 + 1e-9)
    w, b, momentum = np.zeros(m), 0.0, 1.0
    zw, zb = w, b
    for _ in range(rounds):
        e = 1 / (1 + np.exp(-(r @ zw + zb))) - y
        nw = zw - step * (r.T @ e) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = zb - step * e.mean()
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        zw, zb = nw + (momentum - 1) / after * (nw - w), nb + (momentum - 1) / after * (nb - b)
        w, b, momentum = nw, nb, after
    return float(b), w


class RuleEnsemble:
    """An intercept and weighted rules over the statistics."""

    def __init__(self, intercept: float, rules: list[tuple[Rule, float]]) -> None:
        self.intercept, self.rules = intercept, rules

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
        if not len(y) or y.min() == y.max():
            return cls(0.0 if not len(y) else (4.0 if y[0] else -4.0), [])
        rules = grow(x, y)
        matrix = np.stack([holds(rule, x) for rule in rules], 1).astype(np.float32)
        b, w = lasso(matrix, y)
        return cls(b, [(rule, float(v)) for rule, v in zip(rules, w, strict=True) if v])

    def column(self) -> Column:
        """The score as a column expression over the statistics."""
        terms = [F.when(reduce(lambda a, c: a & c, [(F.col(STATISTICS[j]) > cut) if above else (F.col(STATISTICS[j]) <= cut) for j, above, cut in rule]), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.rules]
        return 1 / (1 + F.exp(-reduce(add, terms, F.lit(self.intercept))))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", most: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``most`` labelled texts, which reach the driver: those of the least hash.

    Copies with one label count once, whatever their ids; a null text is an empty one.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("double").alias("__label")).distinct()
    texts = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("__text")).withColumn("__draw", F.xxhash64("__text"))
    # hashes first: the texts of the sample alone are carried on
    drawn = texts.select("doc_id", "__draw").join(bounded(marked, 24), "doc_id").select("__draw", "__label").distinct().orderBy("__draw", "__label").limit(most)
    chosen = F.broadcast(drawn)  # ``most`` rows at most
    joined = texts.join(F.broadcast(drawn.select("__draw").distinct()), "__draw", "left_semi").dropDuplicates(["__draw"]).join(chosen, "__draw")
    rows = with_statistics(joined.select("__draw", "__label", "__text"), "__text").toPandas().sort_values(["__draw", "__label"])
    return rows[STATISTICS].to_numpy(np.float64), rows["__label"].to_numpy(np.float64)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text") -> DataFrame:
    """``docs`` without its text, with the statistics, ``score`` and ``predicted``."""
    model = RuleEnsemble.fit(*training_rows(docs, labels, label, text))
    scored = with_statistics(drop_clashing(docs, ["score", "predicted"]), text).withColumn("score", model.column())
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def held_out(parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality_scores(docs.select("doc_id", "text"), labels.where(~held_out(4, 2)))
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")
