"""Operator 2, exact n-gram Jaccard join: a size-aware heavy-light join.

A document's set holds the hashes of its distinct five-word shingles. Equal sets are one node, so
copies never meet in pairs. Links between nodes are found in two ways, and the boundary between them
is the size at which their estimated costs cross:

* light: sets up to the boundary enumerate their subsets of each overlap size that a partner may
  need. Two sets that share such a subset are linked with no further check, and linking all to the
  smallest set of the subset loses none.
* heavy: sets above it scan inverted lists. A list holds the sets that have its shingle among their
  first ``size / 4 + 1`` shingles, in an order that puts frequent shingles last; sets that link share
  one. First every set is checked against two pivots of its lists, which joins groups of near copies
  without pairing their members. Then only sets that are still in different components are paired.

Only components are asked for, so links inside a known component need no check; no link between
components is lost. A shingle's hash has 64 bits; a set and a subset are known by 128. Tables carry
row numbers for sets, and shingles alone move through the shuffles.

Defined results: a null or empty text has no shingles and is alone; fewer than five words make one
shingle; very long texts are read whole; repeated rows are copies, and rows that repeat a ``doc_id``
with another text are rows of their own; a null ``doc_id`` never names a component if it has another
member; ``doc_id`` may have any type that has an order; other columns are left out, or kept as they
are by ``one_of_each``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import BROADCAST_BYTES, bounded, discarded, nested, settled, table, written
from lumenfold.llm.components import components

WORDS = 5
#: A shingle in this share of the documents or more is frequent and goes last in the order.
FREQUENT = 1 / 5000
#: Only the order depends on the table of frequent shingles; it keeps the most frequent ones.
MAX_FREQUENT = 1_000_000
#: Rare shingles with keys below this, a quarter of all, are in the lists of every set, so what two sets share of them is known.
LOW = 1 << 61
#: Largest boundary that the cost comparison may choose.
MAX_LIGHT = 12
#: Cost of one exact check, in written rows.
CHECK_COST = 20
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Shingler:
    """Sorted hashes of the distinct shingles of each text of a column, as unsigned 64-bit integers.

    A word's hash is a polynomial of its bytes, taken from running sums over all texts of a chunk, and
    a shingle's mixes the hashes of its words.
    """

    BASE = 0x9E3779B97F4A7C15
    CHUNK = 1 << 19

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.low = np.arange(256, dtype=np.uint64)
        self.low[65:91] += np.uint64(32)

    def __call__(self, column: pa.Array) -> Iterator[np.ndarray]:
        texts: list[bytes] = []
        held = 0
        for value in column:
            text = value.as_py() or b""
            if texts and held + len(text) > self.CHUNK:
                yield from self._chunk(texts)
                texts, held = [], 0
            texts.append(text)
            held += len(text) + 1
        if texts:
            yield from self._chunk(texts)

    def _chunk(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        data = np.frombuffer(b" ".join([*texts, b""]) + b" ", np.uint8)
        if len(data) > len(self.up):
            self.up, self.down = _powers(self.BASE, len(data)), _powers(pow(self.BASE, -1, 1 << 64), len(data))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((self.low[data] + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
            blank = np.concatenate([[True], self.space[data]])
            edges = np.flatnonzero(blank[1:] != blank[:-1])
            starts, ends = edges[0::2], edges[1::2]
            h = (sums[ends] - sums[starts]) * self.down[starts]
            h = (h ^ (h >> np.uint64(32))) * _ODD[4]
            h ^= h >> np.uint64(29)
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)])).tolist()
        whole = self._mixed(h, WORDS) if len(h) >= WORDS else h[:0]
        for first, last in zip(bounds, bounds[1:], strict=False):
            n = last - first
            if n >= WORDS:
                yield np.unique(whole[first : last - WORDS + 1])
            else:
                yield self._mixed(h[first:last], n) if n else h[:0]

    @staticmethod
    def _mixed(h: np.ndarray, k: int) -> np.ndarray:
        n = len(h) - k + 1
        with np.errstate(over="ignore"):
            out = np.full(n, np.uint64(k) * _ODD[4], np.uint64)
            for i in range(k):
                out = (out ^ (out >> np.uint64(29))) * _ODD[0] + h[i : i + n] * _ODD[i % 5]
            out ^= out >> np.uint64(31)
            out *= _ODD[1]
            out ^= out >> np.uint64(30)
        return out


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    values = np.concatenate(sets) if sets else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _identity(s: np.ndarray) -> tuple[int, int] | tuple[None, None]:
    """128 bits of a whole set as two signed numbers; nulls for an empty one."""
    if not len(s):
        return None, None
    high, low = divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64)
    return high - (1 << 63), low - (1 << 63)


def _frequent_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, documents) of each batch's frequent shingles; a null shingle counts the documents."""
    shingles = Shingler()
    for batch in batches:
        found = list(shingles(_column(batch, "bytes")))
        keys, counts = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
        keep = counts >= max(3, FREQUENT * len(found))
        yield pa.record_batch({"shingle": pa.array([None, *keys[keep].view(np.int64).tolist()], pa.int64()), "docs": pa.array([len(found), *counts[keep].tolist()], pa.int64())})


def frequent_shingles(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles in ascending order, and their ranks by count. It only sets an order."""
    counts = docs.select(F.col(text).cast("binary").alias("bytes")).mapInArrow(_frequent_part, "shingle long, docs long").groupBy("shingle").agg(F.sum("docs").alias("docs"))
    counts = written(counts, "frequent")
    total = counts.where("shingle IS NULL").select(F.sum("docs")).first()[0] or 0
    rows = counts.where("shingle IS NOT NULL").where(F.col("docs") >= max(3, FREQUENT * total)).orderBy(F.desc("docs"), "shingle").limit(MAX_FREQUENT).toArrow()
    keys = rows.column("shingle").to_numpy().view(np.uint64)
    ranks = np.arange(len(keys), 0, -1)
    order = np.argsort(keys)
    return keys[order], ranks[order]


def _ordered(s: np.ndarray, keys: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set's keys in the common order: rare shingles by hash, then frequent ones, the rarest first.

    A rare shingle's key is positive, a frequent one's negative, so that a list's kind shows in its key.
    """
    if not len(s) or not len(keys):
        return (s >> np.uint64(1)).view(np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
    last = keys[at] == s
    common = s[last][np.argsort(ranks[at[last]], kind="stable")]
    return (s[~last] >> np.uint64(1)).view(np.int64), (common | np.uint64(1 << 63)).view(np.int64)


def _sketcher(spread) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in batches:
            sizes, highs, lows, prefixes, n_low, firsts = [], [], [], [], [], []
            for s in shingles(_column(batch, "bytes")):
                n = len(s)
                sizes.append(n)
                high, low = _identity(s)
                highs.append(high)
                lows.append(low)
                rare, common = _ordered(s, *spread.value)
                n_low.append(int(np.searchsorted(rare, LOW)))
                firsts.append(max(n // 4 + 1, n_low[-1]) if n else 0)
                order = np.concatenate([rare, common])
                prefixes.append(order if n <= MAX_LIGHT else order[: firsts[-1]])
            yield pa.record_batch(
                {
                    "rid": _column(batch, "rid"),
                    "doc_id": _column(batch, "doc_id"),
                    "text_md5": _column(batch, "text_md5"),
                    "n_shingles": pa.array(sizes, pa.int64()),
                    "high": pa.array(highs, pa.int64()),
                    "low": pa.array(lows, pa.int64()),
                    "n_low": pa.array(n_low, pa.int32()),
                    "n_first": pa.array(firsts, pa.int32()),
                    "prefix": _lists(prefixes),
                }
            )

    return run


def sketches(docs: DataFrame, spread, text: str = "text") -> DataFrame:
    """(rid, doc_id, text_md5, n_shingles, high, low, n_low, n_first, prefix) of every row.

    rid: a number of the row. high, low: the identity of the whole set. prefix: the set's first keys
    in the common order; the whole set where it has ``MAX_LIGHT`` shingles or fewer. n_low: how many
    rare ones are below ``LOW``; n_first: how many go into lists.
    """
    found = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.md5(F.col(text).cast("binary")).alias("text_md5"), F.col(text).cast("binary").alias("bytes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(_sketcher(spread), f"rid long, doc_id {kind}, text_md5 string, n_shingles long, high long, low long, n_low int, n_first int, prefix array<long>")


def overlap(a: int, b: int) -> int:
    """Least intersection of linked sets of these sizes: ceil(3 (a + b) / 7)."""
    return -(-3 * (a + b) // 7)


def overlap_sizes(a: int, most: int) -> list[int]:
    """The overlaps that a set of size ``a`` needs with partners of size ``most`` or less."""
    return sorted({overlap(a, b) for b in range(-(-3 * a // 4), 4 * a // 3 + 1) if 1 <= b <= most and overlap(a, b) <= min(a, b)})


def boundary(nodes: DataFrame) -> int:
    """The largest light size, where enumerating subsets costs less rows than scanning lists."""
    small = nodes.where(F.col("size").between(1, MAX_LIGHT))
    sizes = {r[0]: r[1] for r in small.groupBy("size").count().collect()}  # MAX_LIGHT rows at most
    lists = small.select(F.explode("prefix").alias("shingle")).groupBy("shingle").count()
    entries, met = lists.agg(F.sum("count"), F.sum(F.col("count") * (F.col("count") - 1))).first()
    partners = (met or 0) / (entries or 1)

    def cost(x: int) -> float:
        light = sum(n * sum(comb(a, c) for c in overlap_sizes(a, x)) for a, n in sizes.items() if a <= x)
        heavy = sum(n * (a // 4 + 1) * (1 + (CHECK_COST * partners if a > x else 0)) for a, n in sizes.items() if a >= -(-3 * (x + 1) // 4))
        return light + heavy

    return min(range(MAX_LIGHT + 1), key=cost)


def _subsets(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, need, highs, lows = [], [], [], [], []
            for node, s in zip(_column(batch, "node").to_pylist(), _column(batch, "prefix").to_pylist(), strict=True):
                s = np.sort(np.array(s, np.int64))
                for c in overlap_sizes(len(s), most):
                    for part in combinations(s.tolist(), c):
                        high, low = _identity(np.array(part, np.int64))
                        nodes.append(node)
                        sizes.append(len(s))
                        need.append(c)
                        highs.append(high)
                        lows.append(low)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (nodes, sizes, need, highs, lows)], names=["node", "size", "need", "high", "low"])

    return run


def _needed(a: str, b: str):
    return F.ceil(3 * (F.col(a) + F.col(b)) / 7)


def light_links(nodes: DataFrame, most: int) -> DataFrame:
    """Links (a, b) among sets of ``most`` shingles or less, each to the smallest set of a subset.

    If a set needs a larger overlap with the smallest set than the subset has, it needs as much or
    more with every other set there, so the star holds all that the subset can show.
    """
    keyed = nodes.where(F.col("size").between(1, most)).select("node", "prefix").mapInArrow(_subsets(most), "node long, size long, need long, high long, low long")
    keyed = written(keyed, "subsets")
    least = keyed.groupBy("need", "high", "low").agg(F.min(F.struct("size", "node")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = keyed.join(least, ["need", "high", "low"]).select("node", "size", "need", F.col("least.node").alias("other"), F.col("least.size").alias("least"))
    return joined.where((F.col("node") != F.col("other")) & (_needed("size", "least") <= F.col("need"))).select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()


def _sets(spread) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in batches:
            found, names = [], []
            for s in shingles(_column(batch, "bytes")):
                names.append(_identity(s))
                found.append(np.concatenate(_ordered(s, *spread.value)))
            yield pa.record_batch({"high": pa.array([n[0] for n in names], pa.int64()), "low": pa.array([n[1] for n in names], pa.int64()), "shingles": _lists(found)})

    return run


@dataclass
class Corpus:
    """What the steps read again: the documents, the nodes (high, low, node, first_id, size), the order of shingles."""

    docs: DataFrame
    ids: DataFrame
    spread: Broadcast
    text: str

    def whole_sets(self, wanted: DataFrame) -> DataFrame:
        """(node, shingles) of the nodes in ``wanted``, read again from the documents that stand for them.

        The documents' ids are broadcast if they are few enough, and joined otherwise.
        """
        names = written(self.ids.join(bounded(wanted.select("node")), "node", "left_semi").select("node", "high", "low", "first_id"), "names")
        source = self.docs.select(F.struct("doc_id").alias("row"), F.col(self.text).cast("binary").alias("bytes"))
        source = source.join(bounded(names.select("first_id")), F.col("row.doc_id").eqNullSafe(F.col("first_id")), "left_semi")
        sets = source.select("bytes").mapInArrow(_sets(self.spread), "high long, low long, shingles array<long>")
        sets = written(sets.join(bounded(names.select("node", "high", "low")), ["high", "low"]).select("node", "shingles"), "sets")
        rows, distinct = sets.agg(F.count("node"), F.count_distinct("node")).first()
        return sets if rows == distinct else written(sets.dropDuplicates(["node"]), "sets")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of nodes whose whole sets have a similarity of 0.75 or more.

        The sets of ``b`` are broadcast if their bytes are few enough: pairs with pivots have few.
        """
        ends = pairs.select("a").distinct(), pairs.select("b").distinct()
        sets = self.whole_sets(written(ends[0].union(ends[1]).toDF("node").distinct(), "wanted"))
        of_b = sets.join(bounded(written(ends[1], "hubs")), F.col("node") == F.col("b"), "left_semi").select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        size = of_b.agg(F.sum(F.size("sb") * 8 + 32)).first()[0] or 0
        of_a = sets.join(bounded(pairs), F.col("node") == F.col("a")).select("a", "b", F.col("shingles").alias("sa"))
        joined = of_a.join(F.broadcast(of_b) if size <= BROADCAST_BYTES else of_b, "b")
        both = F.size(F.array_intersect("sa", "sb"))
        return joined.where(100 * both >= 75 * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _with_list_facts(entries: DataFrame, **facts: Column) -> DataFrame:
    """``entries`` with aggregates over their list, the rows of the same shingle.

    Lists of frequent shingles may be long, so their aggregates are combined before the shuffle and
    joined; each other list has a share ``FREQUENT`` of the sets at most, and takes one shuffle.
    """
    rare = entries.where("shingle >= 0").withColumns({k: f.over(Window.partitionBy("shingle")) for k, f in facts.items()})
    common = entries.where("shingle < 0")
    made = written(common.groupBy("shingle").agg(*[f.alias(k) for k, f in facts.items()]), "frequent-lists")
    return rare.unionByName(common.join(bounded(made, 64), "shingle"))


def inverted_lists(nodes: DataFrame, most: int) -> DataFrame:
    """(shingle, node, n) of all lists of two sets or more that a heavy set may need; n: sets in the list."""
    large = nodes.where((F.col("size") >= -(-3 * (most + 1) // 4)) & (F.col("size") > 0))
    entries = large.select("node", F.explode(F.slice("prefix", F.lit(1), F.col("n_first"))).alias("shingle"))
    return _with_list_facts(entries, n=F.count(F.lit(1))).where("n > 1")


def listed_nodes(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, size, n_low, n_first, listed, listed_low, score) of the sets in ``lists``.

    listed, listed_low: how many of its first shingles, and of its low ones, are in lists. score: how
    many sets share an entry of the set on average. Of near copies, that which the others were made
    from has the highest, as it has no shingles of its own.
    """
    low = F.col("shingle").between(0, LOW - 1)
    sums = lists.groupBy("node").agg(F.count(F.lit(1)).alias("listed"), F.sum(low.cast("int")).alias("listed_low"), F.sum("n").alias("met"))
    return nodes.select("node", "size", "n_low", "n_first").join(sums, "node").withColumn("score", F.col("met") / F.col("n_first")).drop("met")


def _compatible(a: str, b: str):
    return (4 * F.col(a) >= 3 * F.col(b)) & (4 * F.col(b) >= 3 * F.col(a))


def pivot_pairs(lists: DataFrame, listed: DataFrame) -> DataFrame:
    """Candidates (a, b): each set with the set of the highest score and the least set of a list.

    They only join groups early, so candidates that share few list entries are left to the exact round.
    """
    known = bounded(listed.select("node", "size", "score"), 40)
    entries = lists.join(known, "node").select("shingle", "node", "size", "score")
    ends = _with_list_facts(entries, p=F.max(F.struct("score", "node", "size")), q=F.min(F.struct("node", "size")))
    met = ends.select("node", "size", F.explode(F.array_distinct(F.array(F.struct("p.node", "p.size"), "q"))).alias("p")).where("node != p.node")
    met = met.where(_compatible("size", "p.size"))
    counted = met.groupBy("node", F.col("p.node").alias("other")).agg(F.count(F.lit(1)).alias("shared"), F.first(F.least("size", "p.size")).alias("least"))
    return counted.where(3 * F.col("shared") >= F.floor(F.col("least") / 4) + 1).select(F.col("node").alias("a"), F.col("other").alias("b"))


def _in_mixed_lists(members: DataFrame, **facts: Column) -> DataFrame:
    """The rows whose list has sets of several components, with other ``facts`` of the list."""
    return _with_list_facts(members, lo=F.min("root"), hi=F.max("root"), **facts).where("lo < hi").drop("lo", "hi")


def foreign(wanted: DataFrame, corpus: Corpus) -> DataFrame:
    """(node, root, shingle, n): the whole sets of ``wanted`` (node, root, size), as far as other components know them.

    No overlap with a set of another component can be larger than what is left of a set. Sets that
    keep less than a partner may need fall away; what only these know doesn't count the second time.
    n: sets that are left in the shingle's list.
    """
    sets = corpus.whole_sets(wanted)
    each = sets.join(bounded(wanted.select("node", "root")), "node").select("node", "root", F.explode("shingles").alias("shingle"))
    for _ in range(2):
        each = written(_in_mixed_lists(each), "mixed")
        kept = each.groupBy("node").agg(F.count(F.lit(1)).alias("known")).join(bounded(wanted.select("node", "size")), "node").where(4 * F.col("known") >= 3 * F.col("size"))
        each = each.join(bounded(written(kept.select("node"), "known")), "node", "left_semi")
    return written(_in_mixed_lists(each, n=F.count(F.lit(1))), "foreign")


def _room(a: str, b: str):
    """How many shingles of a set of size ``a`` a linked set of size ``b`` may lack."""
    return F.floor((4 * F.col(a) - 3 * F.col(b)) / 7)


def _meeting(lists: DataFrame, listed: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """(node, root, size) of the sets whose components may link in a list of prefixes.

    A set's low shingles are in lists wherever they are shared, so of them only ``_room`` may be
    unlisted. And one of two sets has a prefix that ends first: all its unshared entries are missing in
    the other, so counted from unlisted ones and short lists, one of its first ``_room + 1`` is shared.
    """
    known = written(listed.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "size", "n_low", "n_first"), "known")
    by_node = Window.partitionBy("node")
    members = _in_mixed_lists(lists.join(bounded(known.select("node", "root")), "node").select("shingle", "node", "root", "n"))
    low = F.col("shingle").between(0, LOW - 1).cast("int")
    members = members.withColumns({"lows": F.sum(low).over(by_node), "nth": F.row_number().over(by_node.orderBy("n", "shingle")), "all": F.count(F.lit(1)).over(by_node)})
    members = members.join(bounded(known.drop("root")), "node").select("shingle", "node", "root", "size", (F.col("n_low") - F.col("lows")).alias("alone"), (F.col("n_first") - F.col("all") + F.col("nth") - 1).alias("place"))
    groups = members.groupBy("shingle", "root").agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.min("place").alias("place"), F.min("alone").alias("alone"))
    groups = written(groups, "groups")
    other = groups.select(*[F.col(c).alias(f"{c}2") for c in groups.columns])
    near = (4 * F.col("hi") >= 3 * F.col("lo2")) & (4 * F.col("hi2") >= 3 * F.col("lo")) & (F.greatest("hi", "hi2") > most)
    near = near & (F.col("alone") <= _room("hi", "lo2")) & (F.col("alone2") <= _room("hi2", "lo"))
    near = near & ((F.col("place") <= _room("hi", "lo2")) | (F.col("place2") <= _room("hi2", "lo")))
    met = groups.join(other, (F.col("shingle") == F.col("shingle2")) & (F.col("root") != F.col("root2")) & near, "left_semi")
    found = written(met.select("root").distinct(), "meeting")
    return known.join(bounded(found), "root", "left_semi").select("node", "root", "size")


def cross_pairs(lists: DataFrame, listed: DataFrame, roots: DataFrame, most: int, corpus: Corpus) -> DataFrame:
    """All candidates (a, b) in different components that may link; one is larger than ``most``.

    The whole sets of components that may meet are cut down to what other components know of them. A
    linked set may lack ``_room`` shingles, of which the unknown ones are some; so one of the first
    few known ones, short lists first, is shared. Only these make pairs, from the component with fewer
    sets. Components are paired first, then their sets, so that sets of one component never meet.
    """
    wanted = written(_meeting(lists, listed, roots, most), "wanted")
    each = foreign(wanted, corpus)
    by_node = Window.partitionBy("node")
    each = each.withColumns({"known": F.count(F.lit(1)).over(by_node), "nth": F.row_number().over(by_node.orderBy("n", "shingle"))}).drop("n", "root")
    weights = wanted.groupBy("root").agg(F.count(F.lit(1)).alias("weight"))
    sizes = written(wanted.join(weights, "root"), "weights")
    each = each.join(bounded(sizes, 48), "node").withColumn("place", F.col("size") - F.col("known") + F.col("nth") - 1)
    each = written(each.select("shingle", "node", "root", "weight", "size", "known", "place"), "places")
    first = each.where(F.col("place") <= F.floor(F.col("size") / 4))

    def groups(df: DataFrame, mark: str) -> DataFrame:
        out = df.groupBy("shingle", "root", "weight").agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.max("known").alias("known"), F.min("place").alias("place"))
        return out.select("shingle", *[F.col(c).alias(c + mark) for c in out.columns[1:]])

    met = groups(first, "1").join(groups(each, "2"), "shingle")
    met = met.where((F.struct("weight1", "root1") < F.struct(F.col("weight2"), F.col("root2"))) & (F.col("place1") <= _room("hi1", "lo2")))
    met = met.where((4 * F.col("hi1") >= 3 * F.col("lo2")) & (4 * F.col("hi2") >= 3 * F.col("lo1")) & (F.greatest("hi1", "hi2") > most) & (F.least("known1", "known2") >= _needed("lo1", "lo2")))
    met = written(met.select("shingle", "root1", "root2", "lo2"), "met")
    left = first.select("shingle", F.col("root").alias("root1"), *[F.col(c).alias(f"{c}_a") for c in ("node", "size", "known", "place")])
    right = each.select("shingle", F.col("root").alias("root2"), *[F.col(c).alias(f"{c}_b") for c in ("node", "size", "known")])
    pairs = bounded(met, 48).join(left, ["shingle", "root1"]).where(F.col("place_a") <= _room("size_a", "lo2"))
    pairs = written(pairs.select("shingle", "root2", "node_a", "size_a", "known_a", "place_a"), "sides")
    pairs = bounded(pairs, 64).join(right, ["shingle", "root2"])
    able = _compatible("size_a", "size_b") & (F.greatest("size_a", "size_b") > most) & (F.least("known_a", "known_b") >= _needed("size_a", "size_b"))
    pairs = pairs.where(able & (F.col("place_a") <= _room("size_a", "size_b")))
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _grouped(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, text_md5, n_shingles, node, group, component_id) of each row of ``docs``.

    node: the row that stands for all rows of an equal set. group: the least node of a component of
    several nodes. Both are null where they don't apply; component_id is given where any of them does.
    """
    docs = docs.select("doc_id", text)
    spread = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, text))
    found = written(sketches(docs, spread, text), "sketches")
    filled = found.where("high IS NOT NULL")
    ids = filled.groupBy("high", "low").agg(F.min("rid").alias("node"), F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("size"), F.count(F.lit(1)).alias("copies"))
    ids = written(ids, "nodes")
    copies = bounded(ids.where("copies > 1").select("high", "low", F.col("node").alias("least")), 48)
    nodes = filled.join(copies, ["high", "low"], "left").where("least IS NULL OR least = rid").select(F.col("rid").alias("node"), F.col("n_shingles").alias("size"), "prefix", "n_low", "n_first")
    most = boundary(nodes)
    lists = written(inverted_lists(nodes, most), "lists")
    listed = written(listed_nodes(lists, nodes), "listed")
    light = written(light_links(nodes, most), "light") if most else None
    slim = written(found.drop("prefix", "n_low", "n_first"), "rows")
    discarded(found)
    corpus = Corpus(docs, ids, spread, text)
    near = corpus.verified(written(pivot_pairs(lists, listed), "pivots"))
    links = written(near.union(light) if light is not None else near, "near")
    roots = components(links)
    crossed = written(cross_pairs(lists, listed, roots, most, corpus), "cross")
    roots = components(links.union(corpus.verified(crossed)))
    least = roots.join(ids.select("node", "first_id"), "node")
    names = written(least.groupBy("root").agg(F.min("first_id").alias("component_id")), "names")
    named = written(roots.join(bounded(names), "root").select("node", F.col("root").alias("group"), "component_id"), "named")
    again = bounded(ids.where("copies > 1").select("high", "low", F.col("node").alias("least"), "first_id"), 64)
    rows = slim.join(again, ["high", "low"], "left").withColumn("node", F.when(F.col("high").isNotNull(), F.coalesce("least", "rid")))
    rows = rows.join(bounded(named), "node", "left")
    return rows.select("doc_id", "text_md5", "n_shingles", "node", "group", F.coalesce("component_id", "first_id", "doc_id").alias("component_id"))


@settled
def jaccard_components(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs``; other columns are left out."""
    return _grouped(docs, text).select("doc_id", "n_shingles", "component_id")


@settled
def extra_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text_md5, stays) of the rows that share a component with another row.

    Of a component one row stays, that of the least ``doc_id`` (a null one is the largest) and then the
    least MD5 of the text. Rows that agree in both are told apart by nothing, so ``stays`` marks a
    pair of which one row stays and which stands more than once.
    """
    rows = _grouped(docs, text).where("node IS NOT NULL").withColumn("group", F.coalesce("group", "node"))
    pairs = written(rows.groupBy("group", "doc_id", "text_md5").agg(F.count(F.lit(1)).alias("times")), "pairs")
    first = pairs.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_md5")).alias("first"), F.sum("times").alias("members"))
    first = written(first.where("members > 1").select("group", "first"), "first")
    marked = pairs.join(bounded(first, 96), "group").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("text_md5").eqNullSafe(F.col("first.text_md5")))
    return marked.where("NOT stays OR times > 1").select("doc_id", "text_md5", "stays")


def one_of_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, columns as they are.

    It is the row of the least ``doc_id``, and of several with that id the one whose text has the
    least MD5. Rows without words are alone and stay. The user's columns travel in one struct, so no
    name clashes.
    """
    extra = extra_rows(docs, text)
    rows = nested(docs, id=F.col("doc_id"), md5=F.md5(F.col(text).cast("binary")))

    def same(marks: DataFrame):
        return F.col("id").eqNullSafe(F.col("doc_id")) & F.col("md5").eqNullSafe(F.col("text_md5")), bounded(marks.select("doc_id", "text_md5"), 96)

    on, gone = same(extra.where("NOT stays"))
    kept = rows.join(gone, on, "left_anti")
    if not extra.where("stays").isEmpty():
        on, twice = same(extra.where("stays"))
        kept = kept.join(twice, on, "left_anti").unionByName(kept.join(twice, on, "left_semi").dropDuplicates(["id", "md5"]))
    return kept.select("row.*")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) u(i) WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
meet AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM meet JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 75 * (p.n + q.n - o)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id
FROM (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) LEFT JOIN n USING (doc_id)"""
