"""The nearest vectors to queries, all at once.

Queries are a stated set: they are broadcast in blocks of a bounded size, each block reads the rows once,
and of each query a task hands on its best rows alone.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.storage import BROADCAST_BYTES

#: Order of scores: to so many digits, so that another order of adding up changes no rank.
DIGITS = 12
#: Scores that a task computes, or holds, at once.
SCORES = 2_000_000
#: Rows that are held against queries at once.
ROWS = 2048


def _blocks(queries: DataFrame, row_bytes: int) -> Iterator[list]:
    """The queries in blocks of at most ``BROADCAST_BYTES``, one in the driver at a time."""
    held: list = []
    for row in queries.toLocalIterator():
        held.append(row)
        if len(held) * row_bytes >= BROADCAST_BYTES:
            yield held
            held = []
    if held:
        yield held


def _first(found: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "key"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k)


def searched(rows: DataFrame, queries: DataFrame, task: Callable, schema: str, row_bytes: int, k: int) -> DataFrame:
    spark, found = rows.sparkSession, []
    for block in _blocks(queries, row_bytes):
        found.append(rows.mapInArrow(task(spark.sparkContext.broadcast(block), k), schema))
    every = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
    return _first(every, k)


class Best:
    """The ``k`` best rows of each of ``n`` queries, of ties those of the least keys; candidates are cut down when they are many."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.held, self.size = k, [], 0
        self.least = np.full(n, -np.inf)  # a row below this is none of the best

    def add(self, at: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.least[at]
        self.held.append(pd.DataFrame({"at": at[good], "key": keys[good], "score": scores[good]}))
        self.size += int(good.sum())
        if self.size > SCORES:
            self.cut()

    def cut(self) -> pd.DataFrame:
        every = pd.concat(self.held, ignore_index=True) if self.held else pd.DataFrame({"at": [], "key": [], "score": []})
        every = every.sort_values(["at", "score", "key"], ascending=[True, False, True])
        every = every[every.groupby("at").cumcount() < self.k]
        full = every.groupby("at")["score"].agg(["size", "min"]).query(f"size == {self.k}")
        self.least[full.index.to_numpy(np.int64)] = full["min"].to_numpy()
        self.held, self.size = [every], len(every)
        return every


def keys_of(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), object) if column.null_count else column.to_numpy(zero_copy_only=False)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; a missing one is of noughts."""
    if not column.null_count and not column.flatten().null_count and len(column.flatten()) == len(column) * width:
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)
        if (lengths == width).all():
            return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)
    return np.array([v or [0.0] * width for v in column.to_pylist()], np.float64).reshape(len(column), -1)


def _near(shared, k: int):
    """The ``k`` nearest rows (key, vector, group) of a task to each query (question_id, vector, group); a query without a group looks at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        wanted = np.array([q[1] for q in queries], np.float64)
        wanted = wanted / np.maximum(np.linalg.norm(wanted, axis=1, keepdims=True), 1e-300)
        by_group = defaultdict(list)
        for i, q in enumerate(queries):
            by_group[q[2]].append(i)
        asked = {group: np.array(own) for group, own in by_group.items()}
        best, kind = Best(len(queries), k), None
        for batch in batches:
            kind = batch.schema.field(0).type
            keys, vectors = keys_of(batch.column(0)), _matrix(batch.column(1), wanted.shape[1])
            length = np.linalg.norm(vectors, axis=1)
            vectors = vectors / np.maximum(length, 1e-300)[:, None]
            rows: dict = defaultdict(list)
            for i, group in enumerate(batch.column(2).to_pylist()):
                if length[i] > 0:
                    rows[group].append(i)
            for group, own in asked.items():
                here = np.flatnonzero(length > 0) if group is None else np.array(rows.get(group, []), np.int64)
                for part in (here[i : i + ROWS] for i in range(0, len(here), ROWS)):
                    step = max(1, SCORES // len(part))
                    for some in (own[i : i + step] for i in range(0, len(own), step)):
                        scores = np.round(wanted[some] @ vectors[part].T, DIGITS)
                        least = np.partition(scores, len(part) - k, axis=1)[:, len(part) - k] if len(part) > k else np.full(len(some), -np.inf)
                        q, r = np.nonzero(scores >= np.maximum(least, best.least[some])[:, None])
                        best.add(some[q], keys[part[r]], scores[q, r])
        if kind is not None:
            found = best.cut()
            ids = np.array([q[0] for q in queries], np.int64)
            yield pa.record_batch({"question_id": pa.array(ids[found["at"].to_numpy(np.int64)]), "key": pa.array(found["key"].tolist(), kind), "score": pa.array(found["score"].to_numpy(np.float64))})

    return run


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, group: str | None = None) -> DataFrame:
    """(question_id, key, score, rank): the ``k`` rows nearest by cosine to each query (question_id, vector, group).

    A query with a group looks at rows of that group only. Ties go to the least key; rows without a
    vector, or with one of length nought, are nobody's. All vectors have one length.
    """
    slim = rows.select(F.col(key).alias("key"), F.col(vector).alias("vector"), (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("group"))
    wanted = queries.select(F.col("question_id").cast("long"), "vector", F.col("group").cast("string") if "group" in queries.columns else F.lit(None).cast("string").alias("group"))
    return searched(slim, wanted, _near, f"question_id long, key {slim.schema['key'].dataType.simpleString()}, score double", 2048, k)
