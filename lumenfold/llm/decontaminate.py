"""Operator 5, benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased and their spaces made single. An item of n characters may lie in a
document with up to ``k = floor(n * MAX_ERROR)`` character edits. Split into k + 1 pieces, one piece
at least lies there unchanged; an automaton of all pieces finds these hits in whole texts, and each
hit's surroundings are verified by Myers' bit-parallel distance, overlapping surroundings at once.

Items are a stated query set: they are broadcast in blocks of a bounded size. Documents are read once:
a task takes them in buffers and holds each buffer against block after block, with one automaton at a time.

Defined results: null and empty texts contain nothing; very long texts are searched whole; items
without words are left out; repeated items and rows count each for itself, so rows that share a
``doc_id`` are judged apart; of equally near places any gives the distance; an empty table on either
side gives no matches; columns of any name stay as they are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import nested, row_schema, table

#: Character edits allowed, as a share of the item's length.
MAX_ERROR = 0.06
#: Characters of items in one broadcast block.
BLOCK_CHARS = 4 << 20
#: Bytes of rows that are held against block after block, where there are several.
BUFFER_BYTES = 32 << 20


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, max_error: float = MAX_ERROR) -> list[tuple[int, str]]:
    """(offset, piece) of the item's budget + 1 pieces, their lengths at most one apart."""
    n = int(len(item) * max_error) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Myers:
    """Least edit distance of a pattern to any substring of a text, 64 or any number of bits wide."""

    def __init__(self, pattern: str) -> None:
        self.n = len(pattern)
        self.bits: dict[str, int] = defaultdict(int)
        for i, c in enumerate(pattern):
            self.bits[c] |= 1 << i
        self.bits = dict(self.bits)

    def best(self, text: str, most: int) -> tuple[int, int] | None:
        """(distance, end) of the first best place within ``most`` edits."""
        n, get = self.n, self.bits.get
        full, top = (1 << n) - 1, n - 1
        up, down, score, found = full, 0, n, None
        for j, c in enumerate(text):
            eq = get(c, 0)
            x = eq | down
            d = (((eq & up) + up) ^ up) | x
            ph = down | (full & ~(d | up))
            mh = up & d
            score += (ph >> top & 1) - (mh >> top & 1)
            ph = ph << 1 & full
            mh = mh << 1 & full
            up = mh | (full & ~(d | ph))
            down = ph & d
            if score <= most and (found is None or score < found[0]):
                found = (score, j + 1)
                if not score:
                    break
        return found


class Matcher:
    """All items of one block against one text after another."""

    def __init__(self, items: list[tuple[int, str]], max_error: float = MAX_ERROR) -> None:
        self.items = [(i, t, int(len(t) * max_error)) for i, t in ((i, normalise(t)) for i, t in items) if t]
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for at, (_, t, _) in enumerate(self.items):
            for offset, piece in pieces(t, max_error):
                places[piece].append((at, offset + len(piece)))
        for piece, where in places.items():
            self.automaton.add_word(piece, where)
        self.automaton.make_automaton()
        self.myers: dict[int, Myers] = {}

    def __call__(self, text: str | None) -> list[tuple[int, int]]:
        """(item_id, distance) of the items that lie in ``text`` within their budget, best distance each."""
        text = normalise(text)
        if not text or not self.items:
            return []
        # diagonal by diagonal: where the item would begin if nothing before the hit were edited
        starts: dict[int, list[int]] = defaultdict(list)
        for end, where in self.automaton.iter(text):
            for at, reach in where:
                starts[at].append(end + 1 - reach)
        found = []
        for at, begins in starts.items():
            item_id, item, most = self.items[at]
            begins = sorted(set(begins))
            best = 0 if any(b >= 0 and text.startswith(item, b) for b in begins) else None
            if best is None:
                ranges: list[list[int]] = []  # surroundings of hits; overlapping ones are one
                for begin in begins:
                    lo, hi = max(0, begin - most), begin + len(item) + most
                    if ranges and lo <= ranges[-1][1]:
                        ranges[-1][1] = hi
                    else:
                        ranges.append([lo, hi])
                myers = self.myers.get(at) or self.myers.setdefault(at, Myers(item))
                best = min((got[0] for lo, hi in ranges if (got := myers.best(text[lo:hi], most))), default=None)
            if best is not None:
                found.append((item_id, best))
        return found


class _Blocks:
    """The items of all blocks against buffers of texts, with the automaton of one block at a time."""

    def __init__(self, blocks: list) -> None:
        self.blocks, self.at, self.match = blocks, None, None

    def _matcher(self, at: int) -> Matcher:
        if at != self.at:
            if self.at is not None:
                self.blocks[self.at].__dict__.pop("_value", None)  # a worker would keep the items of every block
            self.at, self.match = at, Matcher(self.blocks[at].value)
        return self.match

    def over(self, texts: list[str | None], first: bool = False) -> list[list[tuple[int, int]]]:
        """The items in each text; with ``first``, no more than those of the first block that has any."""
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        order = sorted(range(len(self.blocks)), key=lambda i: i != self.at)  # the block that is at hand comes first
        for at in order:
            match = self._matcher(at)
            for own, text in zip(found, texts, strict=True):
                if not (first and own):
                    own += match(text)
        return found


def _buffers(batches: Iterator[pa.RecordBatch], several: bool) -> Iterator[pa.RecordBatch]:
    """The batches as they are, or, for several blocks, in buffers of ``BUFFER_BYTES`` at least."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if not several or size >= BUFFER_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _matcher(blocks: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = _Blocks(blocks)
        for batch in _buffers(batches, len(blocks) > 1):
            ids, items, distances = [], [], []
            for doc_id, own in zip(batch.column(0).to_pylist(), match.over(batch.column(1).to_pylist()), strict=True):
                for item, distance in own:
                    ids.append(doc_id)
                    items.append(item)
                    distances.append(distance)
            yield pa.record_batch({"doc_id": pa.array(ids, batch.schema.field(0).type), "item_id": pa.array(items, pa.int64()), "distance": pa.array(distances, pa.int64())})

    return run


def item_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of ``BLOCK_CHARS`` characters (or one longer item), one in the driver at a time."""
    block, chars = [], 0
    for row in items.select(F.col(item_id).cast("long"), text).where(F.col(text).isNotNull()).toLocalIterator():
        if block and chars + len(row[1]) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append((row[0], row[1]))
        chars += len(row[1])
    if block:
        yield block


def matches(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance) of each document and each item that it contains within the budget."""
    spark = docs.sparkSession
    slim = docs.select("doc_id", F.col(text).alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, distance long"
    return slim.mapInArrow(_matcher([spark.sparkContext.broadcast(block) for block in item_blocks(items)]), schema)


def _clean(blocks: list, place: int):
    """The rows (one struct, the text at ``place``) that contain no item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = _Blocks(blocks)
        for batch in _buffers(batches, len(blocks) > 1):
            found = match.over(batch.column(0).field(place).to_pylist(), first=True)
            yield batch.filter(pa.array([not own for own in found], pa.bool_()))

    return run


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no item, each judged by its own text; columns stay as they are."""
    rows, blocks = nested(docs), [docs.sparkSession.sparkContext.broadcast(block) for block in item_blocks(items)]
    return rows.mapInArrow(_clean(blocks, docs.columns.index(text)), row_schema(rows)).select("row.*")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
