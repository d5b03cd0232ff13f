"""Operator 9, reversible line dedup: sharded cuckoo filters over exact reference counts.

The index is two tables: (shard, key, docs), how many documents hold each line key, and (shard, cells),
a cuckoo filter of each shard's common keys, those of ``min_docs`` documents or more. Inserting
documents adds their keys' counts, deleting them subtracts; keys that cross the limit on the way are
inserted into the filters of their shards, or deleted from them. So the index after a deletion answers
as one that never saw the documents.

Lines are dropped where texts are, as long as all filters fit into ``BROADCAST_BYTES``: they travel to
all tasks, and a line whose key hits its filter goes, unless the exact counts have shown that key to be a
false hit; those few travel with the filters. Beyond that size the keys travel to the filters, and hits
come back to the texts' chunks. Either way a text is split into lines in one Python stage.

Keys are the lines' 128-bit hashes, of which the top bits choose the shard.

Defined results: a null or empty text is one empty line, and a null text becomes an empty one; empty
keys are never dropped; very long texts and lines are read whole; repeated rows count as documents of
their own; a key of exactly ``min_docs`` documents is common; columns of any name stay as they are, but
``n_lines`` and ``n_dropped`` are replaced; an empty table gives an empty index and an empty result.
"""

from __future__ import annotations

import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import BROADCAST_BYTES, drop_clashing, nested, row_schema, table, written

MIN_DOCS = 10
MIN_CHARS = 1
SHARDS = 256
#: Bytes of texts in a chunk, and keys that a task probes at once, where filters are not broadcast.
CHUNK_BYTES = 16 << 20
PROBED_KEYS = 500_000
_BLANK = b" \t\n\x0b\x0c\r"
COUNTS = "shard int, key binary, docs long"
CELLS = "shard int, cells binary, full boolean"
ADDED = "kept binary, n_lines long, n_dropped long"


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The 16-byte key of a line of UTF-8, or None if the line is too short to be dropped."""
    line = line.strip(_BLANK).lower()
    if len(line) < min_chars or (min_chars > 1 and len(line.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(line)


def shard_of(key: bytes, shards: int = SHARDS) -> int:
    return int.from_bytes(key[:4], "big") * shards >> 32


class CuckooFilter:
    """32-bit fingerprints, four to a bucket, two buckets to a key. Holds equal fingerprints of different keys."""

    SLOTS = 4
    KICKS = 500

    def __init__(self, capacity: int = 64, cells: bytes | None = None) -> None:
        buckets = 1
        while buckets * self.SLOTS * 0.85 < capacity:
            buckets *= 2
        self.cells = array("I", cells if cells else bytes(4 * buckets * self.SLOTS))
        self.mask = len(self.cells) // self.SLOTS - 1

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[4:8], "little") or 1
        one = int.from_bytes(key[8:16], "little") & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ mark * 0x5BD1E995) & self.mask

    def __contains__(self, key: bytes) -> bool:
        mark, one, two = self._places(key)
        return mark in self.cells[one * 4 : one * 4 + 4] or mark in self.cells[two * 4 : two * 4 + 4]

    def insert(self, key: bytes) -> bool:
        """Whether there was room; if not, the filter is unchanged."""
        mark, one, two = self._places(key)
        for bucket in (one, two):
            for at in range(bucket * 4, bucket * 4 + 4):
                if not self.cells[at]:
                    self.cells[at] = mark
                    return True
        undo, bucket = [], two
        for kick in range(self.KICKS):
            at = bucket * 4 + (kick * 7 + mark) % 4
            undo.append((at, self.cells[at]))
            mark, self.cells[at] = self.cells[at], mark
            bucket = self._other(bucket, mark)
            for free in range(bucket * 4, bucket * 4 + 4):
                if not self.cells[free]:
                    self.cells[free] = mark
                    return True
        for at, was in reversed(undo):
            self.cells[at] = was
        return False

    def delete(self, key: bytes) -> bool:
        """Remove one copy of a key that was inserted."""
        mark, one, two = self._places(key)
        for bucket in (one, two):
            for at in range(bucket * 4, bucket * 4 + 4):
                if self.cells[at] == mark:
                    self.cells[at] = 0
                    return True
        return False

    def to_bytes(self) -> bytes:
        return self.cells.tobytes()

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        capacity = max(16, len(keys))
        while True:
            made = cls(capacity)
            if all(made.insert(k) for k in keys):
                return made
            capacity *= 2


class FilterBlock:
    """The filters of some shards and their false hits, for many keys at once."""

    def __init__(self, cells: dict[int, bytes], false_hits: set[bytes], shards: int = SHARDS) -> None:
        self.shards, self.false_hits = shards, false_hits
        self.first, self.mask = np.full(shards, -1, np.int64), np.zeros(shards, np.uint64)
        parts, at = [], 0
        for shard, own in sorted(cells.items()):
            self.first[shard], self.mask[shard] = at, len(own) // 16 - 1
            parts.append(np.frombuffer(own, np.uint32))
            at += len(own) // 4
        self.cells = np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def hits(self, keys: list[bytes]) -> np.ndarray:
        """Whether each key hits the filter of its shard, where that is in the block."""
        if not keys or not len(self.cells):
            return np.zeros(len(keys), bool)
        data = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)
        shard = (data[:, :4].copy().view(">u4").ravel().astype(np.uint64) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)
        mark = np.maximum(data[:, 4:8].copy().view("<u4").ravel(), 1)
        here, mask = self.first[shard] >= 0, self.mask[shard]
        one = data[:, 8:16].copy().view("<u8").ravel() & mask
        two = (one ^ mark.astype(np.uint64) * np.uint64(0x5BD1E995)) & mask
        base = np.where(here, self.first[shard], 0)
        found = np.zeros(len(keys), bool)
        for bucket in (one, two):
            at = base + bucket.astype(np.int64) * 4
            for i in range(4):
                found |= self.cells[at + i] == mark
        return found & here

    def common(self, keys: list[bytes]) -> set[bytes]:
        return {k for k, hit in zip(keys, self.hits(keys).tolist(), strict=True) if hit and k not in self.false_hits}


def _counter(min_chars: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[bytes] = Counter()
            for text in batch.column(0).to_pylist():
                found.update({line_key(line, min_chars) for line in set((text or b"").split(b"\n"))})
            found.pop(None, None)
            yield pa.record_batch({"shard": pa.array([shard_of(k, shards) for k in found], pa.int32()), "key": pa.array(list(found), pa.binary()), "docs": pa.array(list(found.values()), pa.int64())})

    return run


def line_counts(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS, shards: int = SHARDS) -> DataFrame:
    """(shard, key, docs) of ``docs``; counts are summed in each batch before they are shuffled."""
    parts = docs.select(F.col(text).cast("binary").alias("bytes")).mapInArrow(_counter(min_chars, shards), COUNTS)
    return parts.groupBy("shard", "key").agg(F.sum("docs").alias("docs"))


def _filter_of(pdf: pd.DataFrame) -> pd.DataFrame:
    made = CuckooFilter.of(sorted(bytes(k) for k in pdf["key"]))
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "cells": [made.to_bytes()], "full": [False]})


def _updated(held: pd.DataFrame, crossed: pd.DataFrame) -> pd.DataFrame:
    """One shard's filter after the keys that became common (``up``) or ceased to be; full if it had no room."""
    shard = (held if len(held) else crossed)["shard"].iloc[0]
    made = CuckooFilter(cells=bytes(held["cells"].iloc[0])) if len(held) else CuckooFilter(16)
    for key in crossed.loc[~crossed["up"], "key"]:
        made.delete(bytes(key))
    full = not all(made.insert(bytes(k)) for k in crossed.loc[crossed["up"], "key"])
    return pd.DataFrame({"shard": [shard], "cells": [made.to_bytes()], "full": [full]})


@dataclass
class LineIndex:
    """Exact counts of line keys, and the filters of those that are common."""

    counts: DataFrame
    filters: DataFrame
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS
    shards: int = SHARDS

    @classmethod
    def of(cls, docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shards: int = SHARDS) -> LineIndex:
        counts = written(line_counts(docs, text, min_chars, shards), "counts")
        return cls(counts, cls._built(counts.where(F.col("docs") >= min_docs)), min_docs, min_chars, shards)

    @staticmethod
    def _built(common: DataFrame) -> DataFrame:
        return written(common.select("shard", "key").groupBy("shard").applyInPandas(_filter_of, CELLS), "filters")

    def insert(self, docs: DataFrame, text: str = "text") -> LineIndex:
        return self._changed(docs, text, 1)

    def delete(self, docs: DataFrame, text: str = "text") -> LineIndex:
        """The index without ``docs``, which must have been inserted; keys that no document holds go."""
        return self._changed(docs, text, -1)

    def _changed(self, docs: DataFrame, text: str, sign: int) -> LineIndex:
        delta = line_counts(docs, text, self.min_chars, self.shards).select("shard", "key", (sign * F.col("docs")).alias("more"))
        both = self.counts.join(delta, ["shard", "key"], "full").select("shard", "key", F.coalesce("docs", F.lit(0)).alias("was"), F.coalesce("more", F.lit(0)).alias("more"))
        both = written(both.withColumn("docs", F.col("was") + F.col("more")), "changed")
        before, after = F.col("was") >= self.min_docs, F.col("docs") >= self.min_docs
        crossed = both.where(before != after).select("shard", "key", after.alias("up"))
        kept = self.filters.join(crossed.select("shard").distinct(), "shard", "left_anti")
        touched = self.filters.join(crossed.select("shard").distinct(), "shard", "left_semi")
        made = written(touched.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(_updated, CELLS), "updated")
        counts = both.where("docs > 0").select("shard", "key", "docs")
        full = made.where("full").select("shard")
        filters = kept.unionByName(made.where("NOT full"))
        if not full.isEmpty():  # a filter without room is built anew, larger, from its shard's exact counts
            filters = filters.unionByName(self._built(counts.where(after).join(full, "shard", "left_semi")))
        return LineIndex(counts, written(filters, "filters"), self.min_docs, self.min_chars, self.shards)

    def filter_bytes(self) -> int:
        return self.filters.agg(F.coalesce(F.sum(F.length("cells")), F.lit(0))).first()[0]


def _probe(shared):
    """The keys (key, docs) that hit a filter of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: FilterBlock = shared.value
        for batch in batches:
            yield batch.filter(pa.array(block.hits(batch.column(0).to_pylist()), pa.bool_()))

    return run


def _dropped(texts: list[bytes | None], min_chars: int, common_of) -> tuple[list[bytes], list[int], list[int]]:
    """The texts without common lines, their lines and how many of them went. common_of: the common ones among keys."""
    split = [(t or b"").split(b"\n") for t in texts]
    keys = {line: line_key(line, min_chars) for line in set().union(*split)} if split else {}
    gone = common_of([k for k in set(keys.values()) if k is not None])
    rest = [[line for line in lines if keys[line] not in gone] for lines in split] if gone else split
    return [b"\n".join(left) for left in rest], [len(lines) for lines in split], [len(lines) - len(left) for lines, left in zip(split, rest, strict=True)]


def _answer(rows: pa.Array, texts: list[bytes], n: list[int], dropped: list[int]) -> dict:
    return {"row": rows, "kept": pa.array(texts, pa.binary()), "n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}


def _dropper(shared, min_chars: int):
    """Texts without the lines that are common by filters that every task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: FilterBlock = shared.value
        for batch in batches:
            yield pa.record_batch(_answer(batch.column(0), *_dropped(batch.column(1).to_pylist(), min_chars, block.common)))

    return run


def _chunker(most: int):
    """Rows with the name of their chunk: ``most`` bytes of texts, or one longer text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, size = uuid.uuid4().hex, 0
        for batch in batches:
            names = []
            for n in pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist():
                if size and size + n > most:
                    name, size = uuid.uuid4().hex, 0
                size += n
                names.append(name)
            yield pa.record_batch({"row": batch.column(0), "kept": batch.column(1), "chunk": pa.array(names, pa.string())})

    return run


def _chunk_keys(min_chars: int, shards: int):
    """(chunk, shard, key): the different line keys of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, set[bytes]] = {}
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(name, set()).update(set((text or b"").split(b"\n")))
            for name, lines in found.items():
                keys = list({line_key(line, min_chars) for line in lines} - {None})
                yield pa.record_batch({"chunk": pa.array([name] * len(keys), pa.string()), "shard": pa.array([shard_of(k, shards) for k in keys], pa.int32()), "key": pa.array(keys, pa.binary())})

    return run


def _hits(shards: int):
    def run(filters: pa.Table, keys: pa.Table) -> pa.Table:
        block = FilterBlock({s: c for s, c in zip(filters["shard"].to_pylist(), filters["cells"].to_pylist(), strict=True)}, set(), shards)
        keys = keys.select(["chunk", "shard", "key"]).combine_chunks()
        return keys.filter(pa.array(block.hits(keys["key"].to_pylist()), pa.bool_()))

    return run


def _drop_from_chunk(min_chars: int):
    def run(rows: pa.Table, hits: pa.Table) -> pa.Table:
        gone = set(hits["key"].to_pylist())
        rows = rows.combine_chunks()
        return pa.table(_answer(rows["row"].combine_chunks(), *_dropped(rows["kept"].to_pylist(), min_chars, lambda keys: gone.intersection(keys))))

    return run


def _by_shuffle(rows: DataFrame, index: LineIndex) -> DataFrame:
    """Rows without common lines where the filters are too many to be sent to every task.

    Rows are written in chunks of a bounded size. The different keys of each chunk go to the filter of
    their shard, hits are confirmed by the exact counts, and come back to their chunk. A key that is in
    any part of all documents is one row a chunk.
    """
    chunked = written(rows.mapInArrow(_chunker(CHUNK_BYTES), row_schema(rows.select("row"), "kept binary, chunk string")), "chunks")
    keys = written(chunked.select("chunk", "kept").mapInArrow(_chunk_keys(index.min_chars, index.shards), "chunk string, shard int, key binary"), "chunk-keys")
    salts = max(1, -(-keys.count() // (index.shards * PROBED_KEYS)))
    salted = keys.withColumn("salt", F.pmod(F.xxhash64("chunk", "key"), F.lit(salts)).cast("int"))
    filters = index.filters.select("shard", "cells").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hits = filters.groupBy("shard", "salt").cogroup(salted.groupBy("shard", "salt")).applyInArrow(_hits(index.shards), "chunk string, shard int, key binary")
    common = index.counts.where(F.col("docs") >= index.min_docs).select("shard", "key")
    sure = written(hits.join(common, ["shard", "key"], "left_semi").select("chunk", "key"), "hits")
    return chunked.groupBy("chunk").cogroup(sure.groupBy("chunk")).applyInArrow(_drop_from_chunk(index.min_chars), row_schema(chunked.select("row"), ADDED))


def drop_common_lines(docs: DataFrame, index: LineIndex, text: str = "text", keys: DataFrame | None = None, most: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with common lines left out of ``text``, and the columns ``n_lines`` and ``n_dropped``.

    keys: (shard, key, docs) of all keys of ``docs`` if they are at hand; else they are counted. Filters of
    ``most`` bytes together are sent to all tasks, and then no text is shuffled.
    """
    spark = docs.sparkSession
    docs = drop_clashing(docs, ["n_lines", "n_dropped"])
    rows = nested(docs, text, kept=F.col(text).cast("binary"))
    if index.filter_bytes() > most:
        found = _by_shuffle(rows, index)
    else:
        if keys is None:
            keys = line_counts(docs, text, index.min_chars, index.shards).select("shard", "key").join(index.counts, ["shard", "key"], "left")
        rare = keys.where(F.coalesce("docs", F.lit(0)) < index.min_docs).select("key")
        cells = {s: bytes(c) for s, c, _ in index.filters.toLocalIterator()}
        shared = spark.sparkContext.broadcast(FilterBlock(cells, set(), index.shards))
        # one key in 600 million hits a filter that hasn't got it
        false_hits = {bytes(r["key"]) for r in rare.mapInArrow(_probe(shared), "key binary").distinct().toLocalIterator()}
        shared = spark.sparkContext.broadcast(FilterBlock(cells, false_hits, index.shards))
        found = rows.mapInArrow(_dropper(shared, index.min_chars), row_schema(rows.select("row"), ADDED))

    def name(c: str) -> Column:
        return F.col("kept").cast("string").alias(c) if c == text else F.col("row").getField(c).alias(c)

    return found.select(*map(name, docs.columns), "n_lines", "n_dropped")


def dedup_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Index ``docs``, then drop the lines common among them."""
    index = LineIndex.of(docs, text, min_docs, min_chars)
    return drop_common_lines(docs, index, text, index.counts)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


SQL = r"""WITH lines AS (
  SELECT rid, doc_id, i, ls[i] AS line,
         translate(regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d, unnest(range(1, len(ls) + 1)) u(i)),
common AS (
  SELECT key FROM (SELECT DISTINCT rid, key FROM lines WHERE key <> '') GROUP BY key HAVING count(*) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(c.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN common c ON lines.key = c.key GROUP BY rid, doc_id"""
