"""In which encoding a text file is, and its lines as text."""

from __future__ import annotations

import codecs
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = 200_000
MARKS = [(codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")]
#: Code pages in question; of equal scores the first wins. Each with the letters that its languages use most.
CODE_PAGES = {
    "cp1252": "éèàçùâêîôûëïüöäßñáíóúãõåøæ’“”–€", "cp1250": "ąćęłńóśźżčďěňřšťůžýáíéúőűöüž", "cp1251": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъ", "koi8-r": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъ", "cp1253": "αοιετσνηυρπκμλωςγδέίόάύήώθχφβξζψ",
    "cp1254": "ışğçöüİŞĞÇÖÜ",
}


@lru_cache
def _pair_scores(page: str) -> np.ndarray:
    """A score for each pair of bytes of a code page, from what characters they are."""
    chars = [bytes([b]).decode(page, "replace") for b in range(256)]
    common = set(CODE_PAGES[page])
    kinds = [unicodedata.category(c) for c in chars]
    script = [unicodedata.name(c, "").split(" ")[0] for c in chars]
    scores = np.zeros((256, 256), np.float32)
    for b in range(128, 256):
        c, kind = chars[b], kinds[b]
        if c == "�" or kind == "Cc":
            own = -4.0
        elif kind[0] == "L":
            own = 1.0 if c in common else 0.5 if c.lower() in common else -0.5
        else:
            own = 0.2 if c in common else -0.3
        scores[:, b] += own
        for a in range(256):
            if kinds[a][0] != "L" or kind[0] != "L":
                continue
            if kinds[a] == "Ll" and kind == "Lu":
                scores[a, b] -= 1.5  # a capital inside a word
            if a >= 128 and script[a] != script[b]:
                scores[a, b] -= 1.5
            if a < 128 and script[b] not in ("LATIN", ""):
                scores[a, b] -= 1.5
        if kind[0] == "L" and script[b] != "LATIN":
            scores[b, [x for x in range(65, 123) if chars[x].isalpha()]] -= 1.5
    return scores.ravel()


def detect(sample: bytes, whole: bool = True) -> str:
    """The encoding of a file by its first bytes. whole: whether these are all; else a cut character at the end is none.

    A byte order mark decides; then valid UTF-8; then bytes that are nought in every second place; then
    the code page whose letters stand together best. Without any byte above 127 it is UTF-8.
    """
    for mark, name in MARKS:
        if sample.startswith(mark):
            return name
    try:
        codecs.getincrementaldecoder("utf-8")().decode(sample, whole)
        utf8 = True
    except UnicodeDecodeError:
        utf8 = False
    data = np.frombuffer(sample, np.uint8)
    if len(data) >= 4 and (data == 0).any():
        even, odd = (data[0::2] == 0).mean(), (data[1::2] == 0).mean()
        if odd > 0.4 and even < 0.1:
            return "utf-16-le"
        if even > 0.4 and odd < 0.1:
            return "utf-16-be"
    if utf8:
        return "utf-8"
    led = np.concatenate([[32], data]).astype(np.int64)  # as if after a blank
    pairs = led[:-1] * 256 + led[1:]
    counts = np.bincount(pairs, minlength=65536)
    totals = [(float(_pair_scores(page) @ counts), -i) for i, page in enumerate(CODE_PAGES)]
    return list(CODE_PAGES)[-max(totals)[1]]


def _detector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [detect(s or b"", n <= SAMPLE) for s, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.record_batch({"path": batch.column(0), "encoding": pa.array(found, pa.string())})


def encodings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, encoding) of text files, by their first ``SAMPLE`` bytes: a row a file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.substring("content", 1, SAMPLE).alias("sample"), "length").mapInArrow(_detector, "path string, encoding string")


def _decoder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(b or b"").decode(e, "replace").removeprefix("﻿") for b, e in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
        yield pa.record_batch({"path": batch.column(0), "block": batch.column(1), "at": batch.column(2), "line": pa.array(texts, pa.string()), "encoding": batch.column(4)})


def decoded_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, block, at, line, encoding): the lines of text files as text, in the order of ``block`` and ``at`` in each file.

    A large file is read in blocks by many tasks, as in all these encodings but UTF-16 and UTF-32 a line
    feed is one byte; files in those two are taken whole. What can't be decoded becomes U+FFFD.
    """
    known = encodings(spark, path)
    kinds = {r["encoding"] for r in known.select("encoding").distinct().collect()}  # a row an encoding
    wide = F.col("encoding").startswith("utf-16") | F.col("encoding").startswith("utf-32")
    out = []
    if any(k[:6] not in ("utf-16", "utf-32") for k in kinds):
        lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("bytes"))
        out.append(lines.join(F.broadcast(known.where(~wide).withColumnRenamed("path", "__p")), F.regexp_replace("path", "^file:/+", "/") == F.regexp_replace("__p", "^file:/+", "/")).select("path", "block", "at", "bytes", "encoding"))
    if any(k[:6] in ("utf-16", "utf-32") for k in kinds):
        whole = spark.read.format("binaryFile").load(path).select("path", "content").join(F.broadcast(known.where(wide)), "path")
        out.append(whole.select("path", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("at"), F.col("content").alias("bytes"), "encoding"))
    if not out:
        return spark.createDataFrame([], "path string, block long, at long, line string, encoding string")
    read = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    text = read.mapInArrow(_decoder, "path string, block long, at long, line string, encoding string")
    each = text.select("path", "block", "at", "encoding", F.posexplode(F.when(wide, F.split("line", "\n")).otherwise(F.array("line"))).alias("pos", "line"))
    return each.select("path", "block", F.when(wide, F.col("pos").cast("long")).otherwise(F.col("at")).alias("at"), F.regexp_replace("line", "\r$", "").alias("line"), "encoding")
