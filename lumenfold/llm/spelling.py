"""Operator 11, spelling variants: one-edit pairs of a vocabulary through an errata trie.

The words are a trie whose nodes are prefixes. At each node the child with most words below is heavy and
its edge the heavy one, so a word has at most log2(words) light edges. Words below a light edge are merged
into the heavy side with one character changed, and are found by what they coincide with:

* replaced: the light character becomes the heavy one. All words that coincide there, the word of the
  heavy side included, differ from each other in that character alone.
* skipped: the light character goes; what it coincides with is a word with one character less.
* heavy character put in before the light one, or at the word's end: a word with one character more.

In a run of equal characters the last one is taken as the one that was put in, so that each pair of words
coincides once. As only light subtrees move (small to large), there are few entries a word, whatever
its length; a word's deletions are never listed.

On Spark: nodes are rolling hashes of prefixes, and edges are counted by (node, character); entries are
grouped by what they coincide with. Of a coinciding group only its size and its best two words are handed
to each member, no pairs; a group has at most as many members as there are characters. A node of which
the hash collides with another's shares its heavy character, which costs entries and changes no result.

Defined results: null and empty texts have no words; very long runs of letters are words like others;
repeated rows count each; a null id is written as nothing before the colon; ties of the count go to the
smallest word by code points; an empty table gives an empty result; columns beside the text and the id
are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import bounded, met, settled, table, written

#: Of a run, after A to Z are lower-cased.
_RUN = re.compile("[a-zÀ-ÿ]+")
MIN_CHARS = 5
MIN_TIMES = 3
RATIO = 2
SLIP = 97
#: Words or steps that a task holds before it hands them on.
_HELD = 400_000
#: Rolling hashes of prefixes: a prime below 2 ** 61 and a multiplier.
_PRIME, _STEP = (1 << 61) - 1, 1_315_423_911_772_541


def slipped(word: str, name: bytes, every: int) -> str:
    """The word, or at one in ``every`` draws by ``name`` the word without one character."""
    h = zlib.crc32(name + b":" + word.encode())
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _counted(found: Counter) -> pa.RecordBatch:
    return pa.record_batch({"word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})


def _word_counter(min_chars: int, slip: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = Counter(_RUN.findall((text or b"").lower().decode("utf-8", "replace")))
                name = (name or "").encode()
                for word, n in own.items():
                    if len(word) >= min_chars:
                        if slip:
                            word = slipped(word, name, slip)  # noqa: PLW2901
                        if len(word) >= min_chars:
                            held[word] += n
                if len(held) > _HELD:
                    yield _counted(held)
                    held = Counter()
        yield _counted(held)

    return run


def vocabulary(docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS, min_times: int = MIN_TIMES, slip: int | None = None) -> DataFrame:
    """(word, n): the words of all texts with how often they occur, counted in tasks before they are shuffled.

    slip: lets one in so many different words of each text lose a character, to try the operator on known slips.
    """
    parts = docs.select(F.col(key).cast("string").alias("name"), F.col(text).cast("binary").alias("bytes")).mapInArrow(_word_counter(min_chars, slip), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_times)


def _prefixes(word: str) -> Iterator[int]:
    """A rolling hash of each prefix of the word, the empty one first and the word itself last."""
    h = 1
    yield h
    for c in word:
        h = (h * _STEP + ord(c) + 1) % _PRIME
        yield h


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of each word's path: its node, its place and its character, which is empty at the word's end."""
    for batch in batches:
        ids, of, nodes, chars, at = batch.column(0), [], [], [], []
        words = batch.column(1).to_pylist()
        for i, word in enumerate(words):
            nodes += _prefixes(word)
            chars += [*word, ""]
            at += range(len(word) + 1)
            of += [i] * (len(word) + 1)
            if len(of) > _HELD or i == len(words) - 1:
                yield pa.record_batch({"id": ids.take(pa.array(of)), "node": pa.array(nodes, pa.int64()), "char": pa.array(chars, pa.string()), "at": pa.array(at, pa.int32())})
                of, nodes, chars, at = [], [], [], []


def light_steps(words: DataFrame) -> DataFrame:
    """(id, light): of each word that has any, the places ``at`` where it leaves a heavy path, and that path's next character.

    The end of a word that other words go on from is such a place too.
    """
    steps = written(words.select("id", "word").mapInArrow(_steps, "id binary, node long, char string, at int"), "steps")
    edges = steps.groupBy("node", "char").agg(F.count("*").alias("below"))
    top = F.max(F.when(F.col("char") != "", F.struct("below", "char")))
    nodes = edges.groupBy("node").agg(F.sum("below").alias("n"), F.count("*").alias("edges"), top["char"].alias("heavy"))
    light = met(steps, written(nodes.where("edges > 1").drop("edges"), "nodes"), "node").where("char <> heavy")
    return light.groupBy("id").agg(F.collect_list(F.struct("at", "heavy")).alias("light"))


#: What a word's light step coincides with: (target, slot). The slot is the place of a replaced character, or -1.
_ENTRIES = """CASE WHEN at = length(word) THEN array(named_struct('target', concat(word, heavy), 'slot', -1)) ELSE filter(array(
  named_struct('target', concat(substring(word, 1, at), heavy, substring(word, at + 2)), 'slot', at),
  named_struct('target', concat(substring(word, 1, at), heavy, substring(word, at + 1)), 'slot', -1),
  named_struct('target', if(substring(word, at + 1, 1) = substring(word, at + 2, 1), NULL, concat(substring(word, 1, at), substring(word, at + 2))), 'slot', -1)),
  x -> x.target IS NOT NULL) END"""


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): of each word with near words their number, and the best as (-n, word).

    words: (id, word, n), a written table with each word once.
    """
    steps = words.join(light_steps(words), "id").select("word", "n", F.inline("light"))
    entries = steps.select("word", "n", F.inline(F.expr(_ENTRIES)))
    groups = entries.groupBy("target", "slot").agg(F.collect_list(F.struct((-F.col("n")).alias("rank"), "word")).alias("own"))
    there = words.select(F.col("word").alias("target"), F.struct((-F.col("n")).alias("rank"), "word").alias("met"))
    both = groups.join(there, "target", "left").where("met IS NOT NULL OR slot >= 0 AND size(own) > 1")
    alike = both.where("slot >= 0").selectExpr("array_sort(if(met IS NULL, own, array_append(own, met))) AS every")
    alike = alike.selectExpr("inline(transform(every, x -> named_struct('word', x.word, 'k', size(every) - 1, 'best', if(x.word = every[0].word, every[1], every[0]))))")
    longer = both.where("slot < 0").selectExpr("inline(array_append(transform(own, x -> named_struct('word', x.word, 'k', 1, 'best', met)), named_struct('word', target, 'k', size(own), 'best', array_min(own))))")
    return alike.unionByName(longer).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where following forms ends. Each round halves what is left of all paths.

    Forms must lead round in no circle; those of ``variants`` don't, as each occurs more often than its word.
    """
    held = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not held.where("moved").isEmpty():
        on = bounded(held.select(F.col("word").alias("root"), F.col("root").alias("further")), 128)
        held = written(held.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
    return held.drop("moved")


@settled
def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n).

    Words are near if they differ by one character put in, left out or replaced. ``form`` is the near word
    of largest ``n``, if that is ``ratio`` (over 1) times the word's; ``root`` is the last of the forms.
    """
    words = written(words.select(F.unhex(F.md5("word")).alias("id"), "word", "n"), "words")
    near = near_words(words)
    often = -F.col("best.rank")
    form = F.when(often >= ratio * F.col("n"), F.col("best.word"))
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), often).alias("form_n"))
    found = written(found, "forms")
    last = roots(found.where("form IS NOT NULL"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text"), slip=SLIP))


SQL = r"""WITH RECURSIVE bits(i, c, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crcs AS MATERIALIZED (SELECT list(c ORDER BY i) AS crc FROM bits WHERE k = 8),
runs AS MATERIALIZED (
  SELECT doc_id, word, sum(n) AS n FROM (
    SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word, 1 AS n
    FROM documents, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) u(w)) GROUP BY ALL),
hashed AS MATERIALIZED (
  SELECT word, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(hex(s)) // 2), lambda i: ('0x' || substring(hex(s), 2 * i::BIGINT + 1, 2))::BIGINT)),
                                              lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)]))) AS h
  FROM (SELECT word, n, coalesce(doc_id::VARCHAR, '') || ':' || word AS s FROM runs), crcs),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN substring(word, 1, h % length(word)) || substring(word, h % length(word) + 2) ELSE word END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS MATERIALIZED (SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS rest FROM words, unnest(range(length(word))) u(i)),
pairs AS (
  SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top, (list(other ORDER BY n DESC, other))[1] AS other FROM pairs GROUP BY word),
formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 2 * w.n THEN other END AS form, CASE WHEN top >= 2 * w.n THEN top END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
chain(word, root, depth) AS (
  SELECT word, word, 0 FROM formed UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, r.root, n, n_near, form_n FROM formed f JOIN (SELECT word, arg_max(root, depth) AS root FROM chain GROUP BY word) r ON f.word = r.word"""
