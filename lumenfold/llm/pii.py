"""Operator 8, personal data by a semi-Markov conditional random field over whole spans.

Exact base rules find e-mail and IP addresses, card and phone numbers. Around anything that could be
personal data lies a zone of words. In a zone every run of up to ``MAX_WORDS`` words is a candidate
segment of every kind, with features of the whole span and its left context; words outside segments
score 0. Dynamic programming over (word, entities so far in its block) chooses boundaries and kinds
jointly. The table has as many entities a block as spans of positive score can end there, so the bound
cuts states and no path that could be the best. Base spans always stay; the path adds spans that
overlap none of them, above all secrets (passwords, tokens, access keys).

Weights maximise the conditional likelihood of labelled segmentations, by forward and backward sums
over all segmentations of a zone, on at most ``MAX_TRAIN`` texts, those with the least hash of their
text. Labels come from the base rules and from a key-value rule for secrets. Every zone is learnt from
twice, as it is and blind to what stands before a span, so the model knows a secret by its own shape
where no rule could.

Defined results: a null or empty text has no spans; very long texts are read whole; of paths with equal
scores the one with fewer spans wins, and of kinds the first of ``KINDS``; repeated rows are scanned
each; columns of any name are kept, but ``spans`` is replaced; an empty table gives an empty result.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import drop_clashing, nested, row_schema, table

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "secret"]
MAX_TRAIN = 1_000
#: Parts of one text that are learnt from, at most, and what ten steps must add to the likelihood of a part for training to go on.
MAX_ZONES = 200
GAIN = 1e-5
STEPS, RATE, RIDGE = 150, 0.15, 1e-4
MAX_WORDS = 6
CONTEXT = 2
#: Words of a block of the dynamic programme, and of a zone to learn from.
BLOCK, TRAIN_WORDS = 16, 48

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# Each is anchored so that a failed start isn't tried again inside the same run of digits.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SECRET = re.compile(r"(?i)(?:password|passwd|secret|token|api[_-]?key)\s?[=:]\s?[\"']?([A-Za-z0-9+/_.-]{8,})|\b(AKIA[0-9A-Z]{10,20})\b")
#: What stands before a secret's value.
_CUE = re.compile(r"(?i)(?:password|passwd|secret|token|key)\s?[=:]\s?[\"']?")
#: A text without it has no span; also read by Java, so without what only Python knows.
_ANY = r"[0-9@=]|[A-Z]{12}|(?i:password|passwd|secret|token|key)\s?:"
_SPARK = re.compile(_ANY)
_TRIGGER = re.compile(r"@|=|[0-9][^0-9]?[0-9][^0-9]?[0-9]|[A-Z0-9]{12}")
_WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")
_CORE = re.compile(r"[A-Za-z0-9+/_.-]{8,}")
_RIGHT, _LEFT = ".,;:!?\"'", "\"'"

#: Words that stand before data of a kind.
CUES = {
    "password": "secret", "passwd": "secret", "token": "secret", "secret": "secret", "key": "secret", "apikey": "secret",
    "tel": "phone", "phone": "phone", "call": "phone", "fax": "phone", "mail": "email", "email": "email", "card": "card", "visa": "card", "ip": "ip", "host": "ip",
}

Span = tuple[int, int, int]  # (kind's place in KINDS, start, end)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def base_spans(text: str) -> list[Span]:
    """The spans of the base rules, by kind and start."""
    spans: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            spans.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    spans += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and _luhn(digits):
            spans.append((2, m.start(), m.end()))
    spans += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return spans


def zones(words: list[tuple[int, int]], text: str) -> list[tuple[int, int]]:
    """Runs [first, last) of words around words with a trigger or a cue that sets a value."""
    out: list[list[int]] = []
    cued = {bisect_right(words, (m.start(), len(text))) - 1 for m in _CUE.finditer(text)}
    for i, (a, b) in enumerate(words):
        if i in cued or _TRIGGER.search(text, a, b):
            first, last = max(0, i - CONTEXT), min(len(words), i + CONTEXT + 1)
            if out and first <= out[-1][1]:
                out[-1][1] = last
            else:
                out.append([first, last])
    return [(a, b) for a, b in out]


def _bucket(n: int, cuts: tuple[int, ...]) -> int:
    return bisect_left(cuts, n)


def features(text: str, start: int, end: int, n_words: int, blind: bool = False) -> list[str]:
    """Names of the features of a whole span; ``blind`` leaves out what stands before it."""
    s = text[start:end]
    digits, letters = sum(c in "0123456789" for c in s), sum(c.isalpha() for c in s)
    number = _digits(s) if digits == len(s) - s.count(" ") - s.count("-") else ""
    out = [
        "bias",
        f"digits{_bucket(digits, (0, 3, 6, 8, 12, 16, 19))}",
        f"letters{_bucket(letters, (0, 3, 8, 15))}",
        f"length{_bucket(len(s), (4, 8, 12, 16, 20, 40))}",
        f"words{n_words}",
        f"shape{s[:1] == '+'}{'@' in s}{s.count('.') == 3}{digits > 0 and letters > 0}",
        f"other{_bucket(len(s) - digits - letters, (0, 1, 3, 6))}",
        f"variety{_bucket(len(set(s)), (4, 7, 10, 14))}",
    ]
    if 13 <= len(number) <= 19:
        out.append(f"luhn{_luhn(number)}")
    if letters and digits and len(s) >= 10 and s.isalnum():
        out.append(f"code{s.isupper()}{_bucket(len(s), (15, 24, 39))}")
    if "=" in s or ":" in s:
        out.append("holds=")
    if not blind:
        before = text[max(0, start - 24) : start].rstrip(" \"'")
        cue = CUES.get(re.sub(r"[^a-z]", "", (before.rstrip("=: ").split() or [""])[-1].lower().rpartition("=")[2]), "none")
        out += [f"cue-{cue}", f"set{before[-1:] in ('=', ':')}"]
    return out


class SpanModel:
    """Weights of (feature, kind) and the segmenter that uses them."""

    def __init__(self, weights: dict[str, list[float]] | None = None) -> None:
        self.weights = weights or {}

    @staticmethod
    def candidates(text: str, words: list[tuple[int, int]], blind: bool = False) -> list[tuple[int, int, int, int, list[str]]]:
        """(first word, last word, start, end, features); quotes and closing marks are trimmed.

        Of one word also what stands after ``=`` or a cue, and its long runs of code characters, are candidates.
        """
        out = []
        for i in range(len(words)):
            for j in range(i + 1, min(len(words), i + MAX_WORDS) + 1):
                start, end = words[i][0], words[j - 1][1]
                places = {(start, end)}
                if j == i + 1:
                    if 0 < (cut := text.rfind("=", start, end) + 1 - start) < end - start:
                        places.add((start + cut, end))
                    places |= {(m.end(), end) for m in _CUE.finditer(text, start, end) if m.end() < end}
                    places |= {m.span() for m in _CORE.finditer(text, start, end)}
                trimmed = set()
                for a, b in places:
                    while b > a and text[b - 1] in _RIGHT:
                        b -= 1
                    while a < b and text[a] in _LEFT:
                        a += 1
                    if a < b:
                        trimmed.add((a, b))
                out += [(i, j, a, b, features(text, a, b, j - i, blind)) for a, b in sorted(trimmed)]
        return out

    def decode(self, n: int, candidates: list) -> list[tuple[int, Span]]:
        """The best path through ``n`` words: (place in ``candidates``, span), by (word, entities) dynamic programming.

        A block's entities are counted up to ``most``, the ends in one block of spans of positive score.
        """
        ending: list[list[tuple[int, int, float, int]]] = [[] for _ in range(n + 1)]
        get, none = self.weights.get, [0.0] * len(KINDS)
        for at, (i, j, _, _, names) in enumerate(candidates):
            scores = [sum(x) for x in zip(*(get(f, none) for f in names), strict=True)]
            kind = max(range(len(KINDS)), key=scores.__getitem__)
            if scores[kind] > 0:  # outside words score 0, so others are on no best path
                ending[j].append((i, at, scores[kind], kind))
        most = max(sum(map(bool, ending[a + 1 : a + BLOCK + 1])) for a in range(0, n, BLOCK)) if n else 0
        if not most:
            return []
        low = float("-inf")
        best = [[0.0] + [low] * most] + [[low] * (most + 1) for _ in range(n)]
        back: list[list[tuple[int, int, int, int] | None]] = [[None] * (most + 1) for _ in range(n + 1)]
        top = [0] * (n + 1)  # the best count at each word's end
        for j in range(1, n + 1):
            row, start = best[j], (j - 1) // BLOCK * BLOCK
            if j - 1 == start:  # a new block counts from nothing
                row[0], back[j][0] = best[start][top[start]], (start, top[start], -1, 0)
            else:
                row[:] = best[j - 1]
                back[j] = [(j - 1, k, -1, 0) for k in range(most + 1)]
            for i, at, score, kind in ending[j]:
                came = [(top[i], best[i][top[i]], 1)] if i <= start else [(k, v, k + 1) for k, v in enumerate(best[i][:most])]
                for k, value, to in came:
                    if value + score > row[to]:
                        row[to], back[j][to] = value + score, (i, k, at, kind)
            top[j] = max(range(most + 1), key=row.__getitem__)
        out, j, k = [], n, top[n]
        while j:
            j, k, at, kind = back[j][k]
            if at >= 0:
                out.append((at, (kind, candidates[at][2], candidates[at][3])))
        return out[::-1]

    def spans(self, text: str | None, base: list[Span] | None = None) -> list[Span]:
        """Base spans, and the path's spans that overlap none of them, by kind and start. base: the base spans, if they are at hand."""
        if not text or not _SPARK.search(text):
            return []
        base = base_spans(text) if base is None else base
        found = list(base)
        taken = sorted((a, b) for _, a, b in base)
        words = [m.span() for m in _WORD.finditer(text)]
        for first, last in zones(words, text):
            candidates = self.candidates(text, words[first:last])
            for _, (kind, a, b) in self.decode(last - first, candidates):
                near = bisect_left(taken, (a, b))
                if not any(x < b and a < y for x, y in taken[max(0, near - len(BASE)) : near + 1]):
                    found.append((kind, a, b))
        return sorted(found)


def weak_spans(text: str) -> list[Span]:
    """The labels to learn from: base spans, and secrets by the key-value rule, earliest first, none overlapping."""
    out: list[Span] = []
    secrets = [(4, *(m.span(1) if m[1] else m.span(2))) for m in _SECRET.finditer(text)]
    for kind, a, b in sorted(base_spans(text) + secrets, key=lambda s: (s[1], s[0])):
        while kind == 4 and b > a and text[b - 1] in _RIGHT:
            b -= 1
        if not out or a >= out[-1][2]:
            out.append((kind, a, b))
    return out


class Lattice:
    """The candidate segments of all zones to learn from, for sums over all segmentations at once.

    Edge e leads in zone ``z`` from before word ``i`` to after word ``j - 1``; its features are a row of
    ``rows``. ``gold`` is its kind in the labels, or -1.
    """

    def __init__(self, zones: list[tuple[int, list, dict[int, int]]], times: list[int] | None = None) -> None:
        """times: how often each zone occurs, once by default."""
        self.names: dict[str, int] = {}
        sets: dict[tuple[int, ...], int] = {}
        edges = []
        for z, (_, candidates, gold) in enumerate(zones):
            for at, (i, j, _, _, found) in enumerate(candidates):
                row = tuple(self.names.setdefault(f, len(self.names)) for f in found)
                edges.append((z, i, j, sets.setdefault(row, len(sets)), gold.get(at, -1)))
        self.times = np.array(times or [1] * len(zones), np.float64)
        self.n_zones, self.words = len(zones), max((n for n, _, _ in zones), default=0)
        self.z, self.i, self.j, self.row, self.gold = np.array(edges, np.int64).reshape(-1, 5).T
        self.holds = np.zeros((len(sets), len(self.names)))
        for row, at in sets.items():
            self.holds[at, list(row)] = 1
        # edges by their end and by their start, those of one zone together
        self.by_end = [self._runs(np.flatnonzero(self.j == j)) for j in range(self.words + 1)]
        self.by_start = [self._runs(np.flatnonzero(self.i == i)) for i in range(self.words + 1)]

    def _runs(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        edges = edges[np.argsort(self.z[edges], kind="stable")]
        first = np.flatnonzero(np.diff(self.z[edges], prepend=-1))
        return edges, first, self.z[edges[first]]

    def gradient(self, weights: np.ndarray) -> tuple[float, np.ndarray]:
        """The log-likelihood of the labels and its gradient, each a zone on average."""
        score = (self.holds @ weights)[self.row]
        top = score.max(1)
        total = top + np.log(np.exp(score - top[:, None]).sum(1))
        ahead = np.zeros((self.words + 1, self.n_zones))
        for j in range(1, self.words + 1):
            ahead[j] = ahead[j - 1]
            edges, first, zone = self.by_end[j]
            if len(edges):
                ahead[j, zone] = np.logaddexp(ahead[j, zone], np.logaddexp.reduceat(ahead[self.i[edges], self.z[edges]] + total[edges], first))
        behind = np.zeros((self.words + 1, self.n_zones))
        for i in range(self.words - 1, -1, -1):
            behind[i] = behind[i + 1]
            edges, first, zone = self.by_start[i]
            if len(edges):
                behind[i, zone] = np.logaddexp(behind[i, zone], np.logaddexp.reduceat(behind[self.j[edges], self.z[edges]] + total[edges], first))
        through = ahead[self.i, self.z] + behind[self.j, self.z] - ahead[-1, self.z]
        change = -np.exp(through[:, None] + score)  # less what the model expects
        labelled = np.flatnonzero(self.gold >= 0)
        change[labelled, self.gold[labelled]] += 1
        change *= self.times[self.z][:, None]
        by_row = np.stack([np.bincount(self.row, change[:, k], len(self.holds)) for k in range(change.shape[1])], 1)
        likelihood = (score[labelled, self.gold[labelled]] * self.times[self.z[labelled]]).sum() - (ahead[-1] * self.times).sum()
        return likelihood / self.times.sum(), self.holds.T @ by_row / self.times.sum()


def train(texts: list[str]) -> SpanModel:
    """The weights of the greatest likelihood, by steps of an adaptive length.

    Of a text with over ``MAX_ZONES`` parts as many are learnt from, evenly spaced. Parts with equal
    features and labels are one, as often as they occur. Steps end when they gain no more.
    """
    found: Counter = Counter()
    for text in texts:
        gold = {(a, b): k for k, a, b in weak_spans(text)}
        words = [m.span() for m in _WORD.finditer(text)]
        parts = [words[a : min(last, a + TRAIN_WORDS)] for first, last in zones(words, text) for a in range(first, last, TRAIN_WORDS)]
        for part in parts[:: -(-len(parts) // MAX_ZONES) or 1]:
            for blind in (False, True):
                candidates = SpanModel.candidates(text, part, blind)
                right: dict[tuple[int, int], int] = {}
                for at, c in enumerate(candidates):
                    if (c[2], c[3]) in gold:
                        right.setdefault((c[2], c[3]), at)
                found[len(part), tuple((i, j, 0, 0, tuple(f)) for i, j, _, _, f in candidates), tuple((at, gold[place]) for place, at in right.items())] += 1
    lattice = Lattice([(n, candidates, dict(gold)) for n, candidates, gold in found], list(found.values()))
    if not len(lattice.z):
        return SpanModel()
    weights = np.zeros((len(lattice.names), len(KINDS)))
    weights[lattice.names["bias"]] = -3
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    reached = []
    for step in range(1, STEPS + 1):
        likelihood, slope = lattice.gradient(weights)
        reached.append(likelihood - RIDGE / 2 * (weights**2).sum())
        if step > 20 and reached[-1] - reached[-11] < GAIN:
            break
        slope -= RIDGE * weights
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        weights += RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return SpanModel({f: weights[at].tolist() for f, at in lattice.names.items()})


def learn(docs: DataFrame, text: str = "text", most: int = MAX_TRAIN) -> SpanModel:
    """The model of at most ``most`` texts that may hold a span (``_ANY``); they reach the driver."""
    marked = docs.where(F.col(text).rlike("(?U)" + _ANY)).select(F.col(text).alias("text"), F.xxhash64(text).alias("draw"))
    # different hashes first, so copies count once; then only the texts of the sample are carried on
    chosen = marked.select("draw").distinct().orderBy("draw").limit(most)
    rows = marked.join(F.broadcast(chosen), "draw", "left_semi").dropDuplicates(["draw"]).orderBy("draw").toLocalIterator()
    return train([r["text"] for r in rows])


def _scanner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: SpanModel = shared.value
        for batch in batches:
            found, base = [], []
            for text in batch.column(1).to_pylist():
                own = base_spans(text) if text and _SPARK.search(text) else []
                found.append(model.spans(text, own))
                base.append(set(own))
            struct = pa.struct([("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("base", pa.bool_())])
            rows = [[{"kind": KINDS[k], "first": a, "last": b, "base": (k, a, b) in own} for k, a, b in f] for f, own in zip(found, base, strict=True)]
            yield pa.record_batch({"row": batch.column(0), "spans": pa.array(rows, pa.list_(struct))})

    return run


def find_pii(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``spans``: kind, first and last (exclusive) code point, whether a base rule found it."""
    slim = nested(drop_clashing(docs, ["spans"]), text, text=F.col(text))
    schema = row_schema(slim, "spans array<struct<kind: string, first: bigint, last: bigint, base: boolean>>")
    return slim.mapInArrow(_scanner(docs.sparkSession.sparkContext.broadcast(model)), schema).select("row.*", "spans")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, learn(docs))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["last"].cast("string"))), ",")

    def count(spans, kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    counts = [count(base, k) for k in BASE]
    added = [count(F.col("spans"), "secret"), F.size("spans").cast("long").alias("n_spans")]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), *added)
