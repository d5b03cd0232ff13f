"""Operator 12, fill-in-middle: texts cut at two seeded units, reordered between sentinels, and rebuilt.

A text is one big integer. ``bytes.translate`` turns its UTF-8 into a mask of a byte class, bit ``8 * i``
for byte ``i``; shifted boolean operations on masks mark the last byte of each unit; ``bit_count`` is the
number of units; and the byte at which the k-th unit ends is found by halving the integer again and
again, on the side that holds the k-th bit. No text is decoded or split into a list.

The cuts are drawn from ``<seed>:<id>``, so a rerun and a retried task make the same output.

Defined results: a null text is an empty one; an empty text, and one that holds a sentinel, stays plain;
very long texts are cut as a whole; a null id is drawn as an empty one; repeated rows get equal outputs;
both cuts may fall together, or at either end, which leaves empty parts; ``n``, ``form``,
``prefix_units``, ``middle_units`` and ``output`` are replaced, other columns stay; an empty table stays
empty. Bytes that are no UTF-8 count with the code point before them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import drop_clashing, nested, row_schema, table

ADDED = "n long, form string, prefix_units long, middle_units long, output binary"
UNITS = ("char", "word", "line")


def _class(*ranges: tuple[int, int]) -> bytes:
    """A table for ``bytes.translate``: 1 for bytes in one of the ranges, else 0."""
    return bytes(any(a <= b <= z for a, z in ranges) for b in range(256))


_FOLLOWS = _class((0x80, 0xBF))
_BLANK = _class((0x09, 0x0D), (0x20, 0x20))
_NEWLINE = _class((0x0A, 0x0A))


def _mask(data: bytes, of: bytes) -> int:
    return int.from_bytes(data.translate(of), "little")


def unit_ends(data: bytes, unit: str = "char") -> int:
    """The last bytes of units, as bits: code points, words with the blanks around them, or lines with their end.

    Blanks before the first word belong to it; a text of blanks only is one word.
    """
    if not data:
        return 0
    last = 1 << 8 * (len(data) - 1)
    if unit == "line":
        return _mask(data, _NEWLINE) | last
    if unit == "word":
        blank = _mask(data, _BLANK)
        starts = blank << 8 & ~blank  # a byte after a blank that is none itself
        starts &= (last << 8) - 1
        if blank & 1:
            starts &= starts - 1  # the first word begins with the blanks before it
    elif unit == "char":
        starts = _mask(data, bytes(1 - x for x in _FOLLOWS))
    else:
        raise ValueError(f"unknown unit {unit!r}, not one of {UNITS}")
    return starts >> 8 | last


def select(mask: int, k: int) -> int:
    """The place of the k-th set bit, from 0, by halving."""
    at, size = 0, mask.bit_length()
    while size > 64:
        half = size >> 1
        low = mask & (1 << half) - 1
        n = low.bit_count()
        if k < n:
            mask, size = low, half
        else:
            k, at, mask, size = k - n, at + half, mask >> half, size - half
    for _ in range(k):
        mask &= mask - 1
    return at + (mask & -mask).bit_length() - 1


def cut(ends: int, units: int) -> int:
    """The byte after the first ``units`` units."""
    return select(ends, units - 1) // 8 + 1 if units else 0


@dataclass(frozen=True)
class Recipe:
    """How texts are changed; rates are percent."""

    unit: str = "char"
    seed: int = 1
    changed: int = 90
    suffix_first: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if any(len(m) < 2 or m[0] in m[1:] for m in marks) or len({m[0] for m in marks}) > 1 or any(a in b for a in marks for b in marks if a is not b):
            raise ValueError("sentinels must begin with one character that they have nowhere else, and none may hold another")

    def apply(self, data: bytes, draw: str) -> tuple[int, str, int | None, int | None, bytes]:
        """Units, form, units of prefix and of middle, and the output. draw: 32 hex digits or more."""
        first, second, third, fourth = (int(draw[i : i + 8], 16) for i in (0, 8, 16, 24))
        ends = unit_ends(data, self.unit)
        n = ends.bit_count()
        p, s, m = (x.encode() for x in (self.prefix, self.suffix, self.middle))
        if not data or third % 100 >= self.changed or p in data or s in data or m in data:
            return n, "plain", None, None, data
        a, b = sorted((first % (n + 1), second % (n + 1)))
        left, right = cut(ends, a), cut(ends, b)
        head, tail = p + data[:left], s + data[right:]
        if fourth % 100 < self.suffix_first:
            return n, "spm", a, b - a, tail + head + m + data[left:right]
        return n, "psm", a, b - a, head + tail + m + data[left:right]


def _transformer(recipe: Recipe):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [recipe.apply(t or b"", d) for t, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            n, form, prefix, middle, output = zip(*made, strict=True) if made else ((),) * 5
            yield pa.record_batch({"row": batch.column(0), "n": pa.array(n, pa.int64()), "form": pa.array(form, pa.string()), "prefix_units": pa.array(prefix, pa.int64()), "middle_units": pa.array(middle, pa.int64()), "output": pa.array(output, pa.binary())})

    return run


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", recipe: Recipe | None = None) -> DataFrame:
    """``docs`` without ``text``, with ``n``, ``form``, ``prefix_units``, ``middle_units`` and ``output``.

    ``form`` is ``plain``, ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle). No shuffle.
    """
    recipe = recipe or Recipe()
    docs = drop_clashing(docs, ["n", "form", "prefix_units", "middle_units", "output"])
    draw = F.sha2(F.concat(F.lit(f"{recipe.seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    rows = nested(docs, text, bytes=F.col(text).cast("binary"), draw=draw)
    made = rows.mapInArrow(_transformer(recipe), row_schema(rows, ADDED))
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c != text]
    return made.select(*own, "n", "form", "prefix_units", "middle_units", F.col("output").cast("string").alias("output"))


def restored(recipe: Recipe | None = None, output: str = "output", form: str = "form") -> Column:
    """The text that an output of this form was made from."""
    recipe = recipe or Recipe()
    p, s, m = recipe.prefix, recipe.suffix, recipe.middle
    out = F.col(output)
    before, middle = F.substring_index(out, m, 1), F.substring_index(out, m, -1)

    def parts(first: str, second: str) -> tuple[Column, Column]:
        return F.substring_index(F.substr(before, F.lit(len(first) + 1)), second, 1), F.substring_index(before, second, -1)

    prefix, suffix = parts(p, s)
    suffix_, prefix_ = parts(s, p)
    return F.when(F.col(form) == "psm", F.concat(prefix, middle, suffix)).when(F.col(form) == "spm", F.concat(prefix_, middle, suffix_)).otherwise(out)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"),
    )


SQL = """WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS one, ('0x' || h[9:16])::BIGINT % (n + 1) AS two,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
cut AS (
  SELECT *, least(one, two) AS a, greatest(one, two) - least(one, two) AS m,
         substring(t, 1, least(one, two)) AS p, substring(t, least(one, two) + 1, greatest(one, two) - least(one, two)) AS mid, substring(t, greatest(one, two) + 1) AS s
  FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || mid ELSE '<S>' || s || '<P>' || p || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut"""
