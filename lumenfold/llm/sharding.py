"""Operator 3, sharding by Karmarkar-Karp differencing (law ``bytes``).

Rows with equal texts are one indivisible group. A group is a partial partition with its bytes in one
slot. Differencing repeatedly takes the two partial partitions of the largest spread and adds them in
opposite order, so that large meets small. It runs in rounds, the same way at every size: over the
large groups, a bounded number; then over buckets of small ones, one task each, where a bucket's share
of the loads so far is one more partial partition. A round takes three quarters of the buckets left, so
that each evens out what the rounds before it have left over; the last bucket meets all loads there are.

Texts are told apart by their MD5. Defined results: a null text has no bytes, and null texts of one
``doc_id`` are a group; empty texts are one group; a group that is larger than a fair shard stays
whole, in a shard of its own as far as that goes; very long texts are read whole; repeated rows are in
one group; ties go by the MD5; columns of any name are kept, but a column ``shard`` is replaced; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import drop_clashing, met, nested, settled, table, written

SHARDS = 40
ROW_BYTES = 16
#: Groups in one bucket.
BUCKET_GROUPS = 20_000
#: A group of more than this part of a fair shard is large.
LARGE = 200
#: Rows of one part for numbering.
PART_ROWS = 50_000


def difference(loads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions, an ascending row of ``k`` loads each, until one is left.

    Returns its loads in ascending order and, for each row given, the final slot of each of its slots.
    Ties go to the row that came first.
    """
    n, k = loads.shape
    ticket = count()
    nodes: list[np.ndarray] = [row for row in loads]
    made: list[tuple[int, int, np.ndarray]] = []
    heap = [(int(row[0] - row[-1]), next(ticket), i) for i, row in enumerate(nodes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        total = nodes[a] + nodes[b][::-1]
        order = np.argsort(total, kind="stable")
        made.append((a, b, order))
        row = total[order]
        nodes[a] = nodes[b] = None
        nodes.append(row)
        heapq.heappush(heap, (int(row[0] - row[-1]), next(ticket), len(nodes) - 1))
    slots = np.empty((n, k), np.int16)
    final = {len(nodes) - 1: np.arange(k, dtype=np.int16)}
    for made_at in range(len(made) - 1, -1, -1):
        a, b, order = made[made_at]
        to = final.pop(n + made_at)
        at = np.empty(k, np.int16)
        at[order] = to  # at[j]: the final slot of what was in place j before sorting
        for child, where in ((a, at), (b, at[::-1])):
            if child < n:
                slots[child] = where
            else:
                final[child] = where.copy()
    if n == 1:
        slots[0] = np.arange(k)
    return nodes[-1], slots


def _bucket(k: int, before: list[int], whole: int | None = None):
    """Difference one bucket of groups against loads that are there: all of them, or the bucket's share of ``whole`` bytes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True], kind="stable")
        own = pdf["bytes"].to_numpy(np.int64)
        start = (np.array(before, np.float64) * (own.sum() / whole if whole else 1.0)).astype(np.int64)
        # among shards with equal loads every bucket has an order of its own, so that leftovers don't pile up
        turn = np.random.default_rng(int(pdf["bucket"].iloc[0])).permutation(k)
        order = turn[np.argsort(start[turn], kind="stable")]
        loads = np.zeros((len(pdf) + 1, k), np.int64)
        loads[0], loads[1:, -1] = start[order], own
        _, slots = difference(loads)
        shard = np.empty(k, np.int32)
        shard[slots[0]] = order
        return pd.DataFrame({"key": pdf["key"].to_numpy(), "bytes": own, "shard": shard[slots[1:, -1]]})

    return run


@settled
def assign(groups: DataFrame, shards: int = SHARDS, bucket_groups: int = BUCKET_GROUPS) -> DataFrame:
    """(key, shard) of a table (key string, bytes long) with a row for each group."""
    n, total = groups.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    large = F.col("bytes") > (total or 0) / (shards * LARGE)  # shards * LARGE groups at most
    buckets = max(1, -(-n // bucket_groups))
    dealt = groups.withColumn("bucket", F.when(large, -1).otherwise(F.pmod(F.xxhash64("key"), F.lit(buckets))))
    loads, done, left = [0] * shards, [], total or 0
    rounds, end = [(-1, 0)], buckets  # the large groups, then three quarters of the buckets that are left, and so on
    while end > 1:
        rounds.append((max(1, end // 4), end))
        end = rounds[-1][0]
    rounds.append((0, 1))
    for first, end in rounds:
        part = dealt.where((F.col("bucket") >= first) & (F.col("bucket") < end)).withColumn("bucket", F.abs("bucket"))
        share = left if first > 0 else None  # the large groups and the last bucket meet all loads
        placed = written(part.groupBy("bucket").applyInPandas(_bucket(shards, loads, share), "key string, bytes long, shard int"), "placed")
        done.append(placed)
        for shard, more in placed.groupBy("shard").agg(F.sum("bytes")).collect():  # ``shards`` rows
            loads[shard] += more
            left -= more
    return reduce(DataFrame.union, done).select("key", "shard")


def text_key(text: str = "text") -> Column:
    return F.coalesce(F.md5(F.col(text)), F.concat(F.lit("null "), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))))


@settled
def shards(docs: DataFrame, text: str = "text", n: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row; slots follow doc_id's hash."""
    t = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(t).cast("long") + ROW_BYTES).alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), text_key(text).alias("key"))
    slim = written(slim, "sizes")
    groups = written(slim.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "groups")
    rows = groups.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-rows // PART_ROWS))
    facts = written(assign(groups.select("key", "bytes"), n).join(groups.select("key", "n"), "key"), "assigned")
    placed = met(slim, facts, "key").drop("key")
    placed = written(placed.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts))), "placed")
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("before", before).drop("c")
    ranked = placed.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")))
    out = ranked.join(starts, ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def with_shard(docs: DataFrame, text: str = "text", n: int = SHARDS) -> DataFrame:
    """``docs`` with the ``shard`` of each row's group; all rows of a text are in one shard."""
    docs = drop_clashing(docs, ["shard"])
    keyed = nested(docs, key=text_key(text), bytes=F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + ROW_BYTES)
    groups = written(keyed.groupBy("key").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")), "groups")
    facts = written(assign(groups.select("key", "bytes"), n).join(groups.select("key", "n"), "key"), "assigned")
    return met(keyed.drop("bytes"), facts, "key").select("row.*", "shard")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
