"""Operator 1, licence scan: template markup compiled into token automata.

A template's words, optional regions and replaceable regions become a small automaton over tokens. A
text is scanned from every place where an automaton can begin; a template is accepted where its
mandatory wording stands word by word, whatever its optional regions hold. Places of the base phrases
are counted beside it, and the labels are those of both.

Defined results: a null or empty text has no words, labels or places, and score 0; very long texts are
scanned whole; of matches that begin at one word the longest counts; repeated rows are scanned each;
columns of any name are kept, but those named as the results are replaced; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import drop_clashing, nested, row_schema, table
from lumenfold.llm.license_templates import PHRASES, TEMPLATES

#: Lower-cases A-Z and makes a space of ASCII that is neither a digit nor a letter.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_MARK = re.compile(r"<<(.*?)>>", re.DOTALL)
ANY = None


def tokens(text: bytes | str | None) -> list[bytes]:
    """The words of a text (of UTF-8 where it is bytes)."""
    if isinstance(text, str):
        text = text.encode()
    return (text or b"").translate(_FOLD).split()


def parse(markup: str) -> list:
    """A nested list: words (bytes), ("var", low, high, pattern) and ("optional", parts)."""
    stack: list[list] = [[]]
    at = 0
    for mark in _MARK.finditer(markup):
        stack[-1].extend(tokens(markup[at : mark.start()]))
        at = mark.end()
        name, *fields = mark[1].split(";")
        if name == "beginOptional":
            stack.append([])
        elif name == "endOptional":
            if len(stack) == 1:
                raise ValueError("endOptional without beginOptional")
            parts = stack.pop()
            stack[-1].append(("optional", parts))
        elif name == "var":
            field = dict(f.split("=", 1) for f in fields)
            low, _, high = field.get("words", "1-1").partition("-")
            stack[-1].append(("var", int(low), int(high or low), field.get("match")))
        else:
            raise ValueError(f"unknown markup {name!r}")
    stack[-1].extend(tokens(markup[at:]))
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0]


class Automaton:
    """States are places between words; the edges of a state lead to others on a word, a pattern or any word."""

    def __init__(self, label: str, markup: str) -> None:
        self.label = label
        self.words: list[dict[bytes, set[int]]] = []
        self.others: list[list[tuple[re.Pattern | None, int]]] = []
        self.free: list[set[int]] = []
        parts = parse(markup)
        self.final = self._build(parts, self._state())
        mandatory = [p for p in parts if isinstance(p, bytes)]
        if not mandatory:
            raise ValueError(f"template {label!r} has no mandatory word")
        #: A text without this word can't match.
        self.anchor = max(mandatory, key=len)
        self.start = self._closed({0})
        if self.final in self.start or any(self.others[s] for s in self.start):
            # a replaceable region may begin a match: the scan tries every word
            self.first = None
        else:
            self.first = {w for s in self.start for w in self.words[s]}

    def _state(self) -> int:
        self.words.append({})
        self.others.append([])
        self.free.append(set())
        return len(self.words) - 1

    def _build(self, parts: list, at: int) -> int:
        for part in parts:
            if isinstance(part, bytes):
                to = self._state()
                self.words[at].setdefault(part, set()).add(to)
                at = to
            elif part[0] == "optional":
                end = self._build(part[1], at)
                out = self._state()
                self.free[end].add(out)
                self.free[at].add(out)
                at = out
            else:
                _, low, high, pattern = part
                made = re.compile(pattern.encode()) if pattern else ANY
                out = self._state()
                for n in range(high):
                    if n >= low:
                        self.free[at].add(out)
                    to = self._state()
                    self.others[at].append((made, to))
                    at = to
                self.free[at].add(out)
                at = out
        return at

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    def longest(self, words: list[bytes], begin: int) -> int | None:
        """The end of the longest match that begins at ``begin``."""
        states, end = self.start, None
        for i in range(begin, len(words)):
            word, after = words[i], set()
            for s in states:
                after |= self.words[s].get(word, frozenset())
                for pattern, to in self.others[s]:
                    if pattern is ANY or pattern.fullmatch(word):
                        after.add(to)
            if not after:
                break
            states = self._closed(after)
            if self.final in states:
                end = i + 1
        return end

    def matches(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Leftmost-longest matches, none overlapping: (first word, end)."""
        out, after = [], 0
        for i, w in enumerate(words):
            if i >= after and (self.first is None or w in self.first):
                end = self.longest(words, i)
                if end is not None:
                    out.append((i, end))
                    after = end
        return out


class Scanner:
    """All templates and phrases against one text after another."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES) -> None:
        self.phrases = [(tokens(p), label) for p, label in phrases]
        by_anchor: dict[bytes, list[Automaton]] = defaultdict(list)
        for label, markup in templates:
            made = Automaton(label, markup)
            by_anchor[made.anchor].append(made)
        self.by_anchor = dict(by_anchor)

    def __call__(self, text: bytes | None) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str]]]:
        """(words, base places (first word, label), template matches (first word, end, label))."""
        words = tokens(text)
        known = set(words)
        base = []
        for phrase, label in self.phrases:
            if known.issuperset(phrase):
                k = len(phrase)
                base += [(i, label) for i in range(len(words) - k + 1) if words[i] == phrase[0] and words[i : i + k] == phrase]
        found = [(a, b, made.label) for anchor, group in self.by_anchor.items() if anchor in known for made in group for a, b in made.matches(words)]
        return len(words), sorted(base), sorted(found)


def score(base: list, found: list) -> float:
    """0 without a sign of a licence, 0.5 with a phrase alone, up to 1 as a match has ten words or more."""
    longest = max((b - a for a, b, _ in found), default=0)
    return 0.5 + 0.05 * min(10, longest) if longest else 0.5 if base else 0.0


_MATCH = pa.struct([("first_word", pa.int64()), ("end", pa.int64()), ("label", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in batches:
        found = [scanner(t) for t in batch.column(1).to_pylist()]
        yield pa.record_batch(
            {
                "row": batch.column(0),
                "n_words": pa.array([f[0] for f in found], pa.int64()),
                "n_base": pa.array([len(f[1]) for f in found], pa.int64()),
                "first_word": pa.array([f[1][0][0] if f[1] else None for f in found], pa.int64()),
                "last_word": pa.array([f[1][-1][0] if f[1] else None for f in found], pa.int64()),
                "base_labels": pa.array([",".join(sorted({x[1] for x in f[1]})) for f in found], pa.string()),
                "labels": pa.array([",".join(sorted({x[1] for x in f[1]} | {x[2] for x in f[2]})) for f in found], pa.string()),
                "score": pa.array([score(f[1], f[2]) for f in found], pa.float64()),
                "matches": pa.array([[{"first_word": a, "end": b, "label": c} for a, b, c in f[2]] for f in found], pa.list_(_MATCH)),
            }
        )


FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<first_word: bigint, end: bigint, label: string>>"
NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the columns of ``FOUND``; ``matches`` has each template's places."""
    docs = drop_clashing(docs, NAMES)
    slim = nested(docs, text, bytes=F.col(text).cast("binary"))
    return slim.mapInArrow(_scan, row_schema(slim, FOUND)).select("row.*", *NAMES)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("matches")
