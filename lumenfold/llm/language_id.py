"""Operator 4, language identification of mixed-language text.

Script ranges narrow the languages that a word may have; character n-grams of the word score the
candidates; a Viterbi path over the words, with a penalty for each switch, labels spans. A text's
language is that of most of its words.

The model is learnt from at most ``MAX_TRAIN`` labelled texts, those with the least hash of their
``doc_id``, and keeps all their n-grams.

Defined results: null texts and texts without a letter are ``und`` with score 0; with nothing to learn
from, all are; words without a letter, such as dashes, fit all languages alike and so go with their
neighbours; very long texts are read whole; ties go to the language that sorts first; repeated rows are
labelled each; columns of any name are kept, but those named as the results are replaced; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import drop_clashing, nested, row_schema, table

MAX_TRAIN = 8_000
SWITCH = 8.0
SMOOTH = 0.3
#: A language is a candidate in a script if it has this share of its words there.
SCRIPT_SHARE = 0.02
CACHED_WORDS = 300_000
#: Bytes of the table of words' scores, whatever the number of languages; a text with more different words has a larger one.
CACHE_BYTES = 64 << 20
CHUNK_WORDS = 1_000_000
UNKNOWN = "und"

#: First and last code points of scripts, after the Unicode block names.
SCRIPTS = [
    ("Latin", 0x41, 0x24F), ("Greek", 0x370, 0x3FF), ("Cyrillic", 0x400, 0x52F), ("Armenian", 0x530, 0x58F),
    ("Hebrew", 0x590, 0x5FF), ("Arabic", 0x600, 0x6FF), ("Devanagari", 0x900, 0x97F), ("Bengali", 0x980, 0x9FF),
    ("Tamil", 0xB80, 0xBFF), ("Thai", 0xE00, 0xE7F), ("Georgian", 0x10A0, 0x10FF), ("Latin", 0x1E00, 0x1EFF),
    ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF),
]

#: ASCII that isn't a letter becomes a space; all else stays.
_KEEP = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_ASCII_LETTER = re.compile(rb"[a-z]")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of UTF-8; empty if the text has no letter."""
    if not text:
        return []
    low = text.lower()
    b = low.encode("utf-8", "replace").translate(_KEEP)
    if not _ASCII_LETTER.search(b) and not any(c.isalpha() for c in low):
        return []
    return b.split()


@cache
def _script(c: str) -> str:
    return next((name for name, a, z in SCRIPTS if a <= ord(c) <= z), "Other")


def script_of(word: str) -> str:
    """The script of most letters of a word; the first of equals."""
    if word.isascii():
        return "Latin"
    return Counter(map(_script, word)).most_common(1)[0][0]


def grams(word: str) -> list[str]:
    """The word itself and its runs of three characters, with marks at both ends."""
    marked = f"<{word}>"
    return [*(marked[i : i + 3] for i in range(len(marked) - 2)), f"={word}"]


def _gram_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, gram, n): counts of n-grams and of words by script."""
    for batch in batches:
        seen: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen.setdefault(lang, Counter()).update(words_of(text))
        out: Counter = Counter()
        for lang, words in seen.items():
            for w, n in words.items():
                word = w.decode("utf-8", "replace")
                out[lang, "script", script_of(word)] += n
                for g in grams(word):
                    out[lang, "gram", g] += n
        yield pa.record_batch({"lang": pa.array([k[0] for k in out], pa.string()), "kind": pa.array([k[1] for k in out], pa.string()), "gram": pa.array([k[2] for k in out], pa.string()), "n": pa.array(list(out.values()), pa.int64())})


class Model:
    """Log-likelihoods of n-grams by language, and the candidate languages of each script."""

    def __init__(self, rows: list[tuple[str, str, str, int]]) -> None:
        self.langs = sorted({r[0] for r in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        counted = [r for r in rows if r[1] == "gram"]
        self.index = {g: i for i, g in enumerate(sorted({r[2] for r in counted}))}
        counts = np.zeros((len(self.index) + 1, len(self.langs)))
        for lang, _, g, n in counted:
            counts[self.index[g], at[lang]] += n
        self.logs = np.log((counts + SMOOTH) / (counts.sum(0) + SMOOTH * len(counts))).astype(np.float32)
        self.scripts: dict[str, np.ndarray] = {}
        words = Counter()
        for lang, kind, name, n in rows:
            if kind == "script":
                words[lang] += n
        for lang, kind, name, n in rows:
            if kind == "script" and n >= SCRIPT_SHARE * words[lang]:
                self.scripts.setdefault(name, np.zeros(len(self.langs), bool))[at[lang]] = True

    def scores(self, words: list[bytes]) -> np.ndarray:
        """A row for each word (none is empty): the languages' log-probabilities; those of other scripts get little."""
        texts = [w.decode("utf-8", "replace") for w in words]
        get, unknown = self.index.get, len(self.index)
        parts = [[get(g, unknown) for g in grams(t)] for t in texts]
        starts = np.cumsum([0, *map(len, parts)])[:-1]
        score = np.add.reduceat(self.logs[np.fromiter(chain.from_iterable(parts), np.int64)], starts, axis=0)
        everything = np.ones(len(self.langs), bool)
        able = np.stack([self.scripts.get(script_of(t), everything) for t in texts])
        score = np.where(able, score, score - 30)
        score[[not any(c.isalpha() for c in t) for t in texts]] = 0
        score -= score.max(1, keepdims=True)
        return score - np.log(np.exp(score).sum(1, keepdims=True))


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of every word; texts are runs of rows of ``scores``, the longest first.

    All texts advance together, a word a step. Staying wins over an equal switch.
    """
    n, langs = scores.shape
    path, moved, source = np.zeros(n, np.int16), np.zeros((n, langs), bool), np.zeros(n, np.int16)
    if not n:
        return path
    value = np.zeros((len(lengths), langs), np.float32)
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # texts longer than t
    for t in range(lengths[0]):
        a = active[t]
        rows = starts[:a] + t
        if t:
            best = value[:a].argmax(1)
            offer = value[np.arange(a), best] - switch
            change = value[:a] < offer[:, None]
            moved[rows], source[rows] = change, best
            value[:a] = np.where(change, offer[:, None], value[:a])
        value[:a] += scores[rows]
    label = value.argmax(1).astype(np.int16)
    for t in range(lengths[0] - 1, -1, -1):
        a = active[t]
        rows = starts[:a] + t
        path[rows] = label[:a]
        if t:
            label[:a] = np.where(moved[rows, label[:a]], source[rows], label[:a])
    return path


def _labeller(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        known: dict[bytes, int] = {}
        langs = max(1, len(model.langs))
        table_ = np.zeros((max(4096, min(CACHED_WORDS * 2, CACHE_BYTES // (4 * langs))), langs), np.float32)
        for batch in batches:
            ids: list[np.ndarray] = []
            out: dict[int, tuple[int, float, list]] = {}
            waiting: list[int] = []

            def settle() -> None:
                order = sorted(waiting, key=lambda i: -len(ids[i]))
                at = 0
                while at < len(order):
                    end, total = at, 0
                    while end < len(order) and (end == at or total + len(ids[order[end]]) <= CHUNK_WORDS):
                        total += len(ids[order[end]])
                        end += 1
                    part = order[at:end]
                    lengths = np.array([len(ids[i]) for i in part])
                    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                    path = viterbi(table_[np.concatenate([ids[i] for i in part])], starts, lengths)
                    for i, s, n in zip(part, starts.tolist(), lengths.tolist(), strict=True):
                        labels = path[s : s + n]
                        votes = np.bincount(labels, minlength=len(model.langs))
                        best = int(votes.argmax())
                        edges = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), n]
                        out[i] = (best, float(votes[best]) / n, [{"lang": model.langs[labels[a]], "first_word": a, "words": b - a} for a, b in zip(edges, edges[1:], strict=False)])
                    at = end
                waiting.clear()

            for i, text in enumerate(batch.column(1).to_pylist()):
                words = words_of(text) if model.langs else []
                fresh = set(words).difference(known)
                if len(known) + len(fresh) > len(table_):
                    settle()
                    known.clear()
                    fresh = set(words)
                    if len(fresh) > len(table_):
                        table_ = np.zeros((len(fresh), table_.shape[1]), np.float32)
                if fresh:
                    new = list(fresh)
                    at = len(known)
                    known.update(zip(new, range(at, at + len(new)), strict=True))
                    table_[at : at + len(new)] = model.scores(new)
                ids.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                if words:
                    waiting.append(i)
            settle()
            got = [out.get(i) for i in range(len(ids))]
            yield pa.record_batch(
                {
                    "row": batch.column(0),
                    "lang_pred": pa.array([UNKNOWN if g is None else model.langs[g[0]] for g in got], pa.string()),
                    "score": pa.array([0.0 if g is None else g[1] for g in got], pa.float64()),
                    "spans": pa.array([[] if g is None else g[2] for g in got], pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("words", pa.int64())]))),
                }
            )

    return run


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = MAX_TRAIN) -> Model:
    """The model of at most ``most`` different texts of ``docs`` that have a language, those of the least hash.

    Copies count once, with the first of their languages.
    """
    usable = docs.select(F.xxhash64(text).alias("draw"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    # hashes first: the texts of the sample alone are carried on
    chosen = usable.groupBy("draw").agg(F.min("lang").alias("lang")).orderBy("draw").limit(most)
    rows = usable.join(F.broadcast(chosen), ["draw", "lang"], "left_semi").dropDuplicates(["draw"]).select("lang", "text")
    counts = rows.mapInArrow(_gram_counter, "lang string, kind string, gram string, n long").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    found = counts.toArrow().to_pydict()  # of the sample alone
    return Model(list(zip(*(found[c] for c in ("lang", "kind", "gram", "n")), strict=True)))


def label_languages(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``lang_pred``, ``score`` and ``spans`` (language, first word, words)."""
    docs = drop_clashing(docs, ["lang_pred", "score", "spans"])
    slim = nested(docs, text, text=F.col(text))
    schema = row_schema(slim, "lang_pred string, score double, spans array<struct<lang: string, first_word: bigint, words: bigint>>")
    return slim.mapInArrow(_labeller(docs.sparkSession.sparkContext.broadcast(model)), schema).select("row.*", "lang_pred", "score", "spans")


def held_out(parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out(3, 1)).select("doc_id", "text", "lang"))
    return label_languages(docs.select("doc_id", "text"), model).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
