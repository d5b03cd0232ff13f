"""Vectors of texts without a model, and their reuse shard by shard.

A text's vector is its words' term frequencies by inverse document frequency, hashed into ``dims`` places
with a sign, and scaled to length one. Inverse document frequencies are a table that is fitted once and
kept, so a vector depends on its own text alone and can be reused while that stays as it is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import SEARCH_STOPWORDS
from lumenfold.operators.integrate import running_ids
from lumenfold.storage import BROADCAST_BYTES, bounded, met, written

DIMS = 64
SHARD = 512
#: Words that a task holds, or hands on, at once.
WORDS = 200_000
#: Steps of one in idf, by which common words are told from rare ones.
STEPS = 16
#: Bytes of a word and its facts in memory.
WORD_BYTES = 64


def _words(least: int) -> Callable[[bytes], Counter]:
    """The words of ``significant_tokens`` in a text of small letters, with how often they occur."""
    found, stop = re.compile(b"[a-z0-9]{%d,}" % max(least, 1)).findall, [w.encode() for w in SEARCH_STOPWORDS]

    def count(text: bytes | None) -> Counter:
        own = Counter(found(text or b""))
        for w in stop:
            own.pop(w, None)
        return own

    return count


def _count_terms(least: int):
    """(chunk_id, word, tf) of texts (chunk_id, content), and of each text a row without a word; a missing id has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _words(least)
        for batch in batches:
            keys, at, words, tf = batch.column(0), [], [], []
            valid = keys.is_valid().to_pylist()

            def made() -> pa.RecordBatch:
                sizes = np.array(at, np.int64).reshape(-1, 2)
                rows = np.repeat(sizes[:, 0], sizes[:, 1])  # noqa: B023
                return pa.record_batch({"chunk_id": keys.take(pa.array(rows)), "word": pa.array(words, pa.binary()).cast(pa.string()), "tf": pa.array(tf, pa.int64())})  # noqa: B023

            for i, text in enumerate(batch.column(1).to_pylist()):
                own = count(text) if valid[i] else {}
                at.append((i, len(own) + 1))
                words.append(None)
                tf.append(0)
                words.extend(own)
                tf.extend(own.values())
                if len(words) > WORDS:
                    yield made()
                    at, words, tf = [], [], []
            if words:
                yield made()

    return run


def _count_texts(least: int):
    """(word, n): how many texts of a task hold each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, n = _words(least), Counter()
        made = lambda: pa.record_batch({"word": pa.array(list(n), pa.binary()).cast(pa.string()), "n": pa.array(list(n.values()), pa.int64())})
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n.update(count(text).keys())
                if len(n) > WORDS:
                    yield made()
                    n.clear()
        yield made()

    return run


def _low(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.lower("content").cast("binary").alias("content"))


def _terms(chunks: DataFrame, least: int) -> DataFrame:
    """(chunk_id, word, tf): words of each text with how often they occur, and a row without a word."""
    return _low(chunks).mapInArrow(_count_terms(least), f"chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, word string, tf long")


def fit_idf(chunks: DataFrame, least: int = 3) -> DataFrame:
    """(word, idf) of chunks (chunk_id, content), and the row of a null word: the idf of a word that none has.

    Texts are counted where they lie; only those of repeated ids, which are one text, meet first.
    """
    repeated = written(chunks.groupBy("chunk_id").agg(F.count("*").alias("rows")).where("rows > 1"), "repeated")
    total = chunks.agg(F.count("*").alias("total"))
    texts = _low(chunks)
    if more := repeated.count():
        ids = repeated.select(F.col("chunk_id").alias("id"))
        ids, same = F.broadcast(ids) if more * 32 <= BROADCAST_BYTES else ids, F.col("chunk_id").eqNullSafe(F.col("id"))
        again = texts.join(ids, same, "left_semi").select(F.struct("chunk_id").alias("chunk_id"), "content")  # a missing id is one, too
        texts = texts.join(ids, same, "left_anti")
        pairs = again.mapInArrow(_count_terms(least), f"chunk_id struct<chunk_id:{chunks.schema['chunk_id'].dataType.simpleString()}>, word string, tf long")
        rest = pairs.where("word IS NOT NULL").select("chunk_id", "word").distinct().groupBy("word").agg(F.count("*").alias("n"))
    found = texts.select("content").mapInArrow(_count_texts(least), "word string, n long")
    seen = (found.unionByName(rest) if more else found).groupBy("word").agg(F.sum("n").alias("df"))
    every = seen.unionByName(chunks.sparkSession.createDataFrame([(None, 0)], "word string, df long"))
    return written(every.join(F.broadcast(total), F.lit(True)).select("word", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf")), "idf")


def bucket(word: Column, dims: int = DIMS) -> tuple[Column, Column]:
    """The place of a word and its sign, from its MD5."""
    h = F.md5(word)
    return F.conv(F.substring(h, 1, 7), 16, 10).cast("long") % dims, F.when(F.substring(h, 8, 1) < "8", 1.0).otherwise(-1.0)


def _common(known: DataFrame) -> float | None:
    """Words with an idf below this may be broadcast; none if all may. A word is the more common the lower its idf."""
    steps = {r["step"]: r["n"] for r in known.groupBy(F.floor(F.col("idf") * STEPS).alias("step")).agg(F.count("*").alias("n")).collect()}  # some hundreds of rows
    held = 0
    for step in sorted(steps):
        held += steps[step]
        if held * WORD_BYTES > BROADCAST_BYTES:
            return step / STEPS
    return None


def embed(chunks: DataFrame, idf: DataFrame, dims: int = DIMS, least: int = 3) -> DataFrame:
    """(chunk_id, vector) of chunks (chunk_id, content), with the frequencies of ``fit_idf``.

    A text without significant words has a vector of noughts. Words are counted where the texts lie and
    meet the frequencies of common words there, as many as may be broadcast; a place's sum travels, and of
    words only the rare ones. Repeated ids are one text; a missing id has noughts.
    """
    known = idf.where("word IS NOT NULL")
    none = idf.where("word IS NULL").first()  # one row
    unknown = F.lit(none["idf"] if none else None).cast("double")
    place, sign = bucket(F.col("word"), dims)
    place, named, missed = place.cast("int"), F.col("word").isNotNull(), F.col("place").isNull()
    below = _common(known)
    common = (known if below is None else known.where(F.col("idf") < below)).select("word", place.alias("place"), (sign * F.col("idf")).alias("weight"))
    met_here = _terms(chunks, least).join(F.broadcast(common), "word", "left")
    if below is None:
        w = F.col("tf") * F.coalesce("weight", sign * unknown)
        sums = met_here.select("chunk_id", F.when(named, F.coalesce("place", place)).otherwise(0).alias("place"), F.when(named, w).otherwise(0.0).alias("w")).groupBy("chunk_id", "place").agg(F.sum("w").alias("w"))
    else:
        rare = F.when(named & missed, F.col("word"))
        slim = met_here.select("chunk_id", F.when(named, F.coalesce("place", place)).otherwise(0).alias("place"), rare.alias("word"), F.when(rare.isNotNull(), F.col("tf")).otherwise(F.coalesce(F.col("tf") * F.col("weight"), F.lit(0.0))).alias("w"))
        parts = written(slim.groupBy("chunk_id", "place", "word").agg(F.sum("w").alias("w")), "parts")
        rest = parts.where(named)
        counts = rest.groupBy("word").agg(F.count("*").alias("n"))
        facts = written(counts.join(known.where(F.col("idf") >= below), "word", "left").select("word", "n", (sign * F.coalesce("idf", unknown)).alias("weight")), "frequencies")
        weighed = met(rest, facts, "word", row_bytes=WORD_BYTES).select("chunk_id", "place", (F.col("w") * F.col("weight")).alias("w"))
        sums = parts.where(~named).select("chunk_id", "place", "w").unionByName(weighed).groupBy("chunk_id", "place").agg(F.sum("w").alias("w"))
    own = sums.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "w"))).alias("m"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    value = lambda i: F.when(F.col("length") > 0, F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("length")).otherwise(0.0)
    return own.select("chunk_id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: value(i)).alias("vector"))


def shards(chunks: DataFrame, order: str = "chunk_id", size: int = SHARD) -> DataFrame:
    """``chunks`` with the ``shard`` of each: so many of them, in their order, from 0."""
    numbered = running_ids(chunks, [order], "S")
    return numbered.select(*chunks.columns, ((F.col("seq_no") - 1) / size).cast("long").alias("shard"), "seq_no")


def fingerprints(placed: DataFrame) -> DataFrame:
    """(shard, fingerprint): a sum over the chunks (seq_no, chunk_id, mark) of a shard that says their ids, their texts' marks and their order."""
    row = F.sha2(F.concat_ws("\n", F.col("seq_no").cast("string"), F.col("chunk_id").cast("string"), F.hex("mark")), 256)
    number = lambda at: F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return placed.groupBy("shard").agg(F.concat_ws(":", F.count("*").cast("string"), number(1), number(16)).alias("fingerprint"))


def refreshed(chunks: DataFrame, held: DataFrame | None, idf: DataFrame, size: int = SHARD, dims: int = DIMS) -> tuple[DataFrame, DataFrame]:
    """(vectors, work): the vectors (chunk_id, shard, fingerprint, vector) of all chunks, and of each shard whether it was made anew.

    held: the vectors of an earlier call, with the same ``idf``. A shard is taken from them if it has the
    same chunks with the same texts in the same order. Marks of texts are ordered and compared; texts stay
    where they lie and are read twice.
    """
    marks = written(chunks.select("chunk_id", F.unhex(F.sha2(F.coalesce("content", F.lit("")), 256)).alias("mark")), "marks")
    placed = written(shards(marks, "chunk_id", size), "placed")
    now = written(fingerprints(placed), "fingerprints")
    if held is None:
        kept = now.select("shard").limit(0)
    else:
        kept = written(now.join(bounded(held.select("shard", "fingerprint").distinct(), 128), ["shard", "fingerprint"], "left_semi").select("shard"), "kept")
    work = now.join(bounded(kept.withColumn("old", F.lit(True)), 16), "shard", "left").select("shard", F.col("old").isNull().alias("made"))
    fresh = bounded(written(placed.join(bounded(kept, 16), "shard", "left_anti").select("chunk_id", "shard").distinct(), "fresh"), 32)
    texts = chunks if kept.isEmpty() else chunks.join(fresh, "chunk_id", "left_semi")
    made = embed(texts, idf, dims).join(fresh, "chunk_id").join(bounded(now, 128), "shard").select("chunk_id", "shard", "fingerprint", "vector")
    if held is not None:
        made = made.unionByName(held.join(bounded(kept, 16), "shard", "left_semi").select("chunk_id", "shard", "fingerprint", "vector"))
    return written(made, "vectors"), work
