"""Variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.llm.spelling import slipped, variants, vocabulary

from .conftest import ODD


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words, ratio=2):
    forms, rows = {}, {}
    for w, n in words.items():
        best = min(((-words[x], x) for x in words if near(w, x)), default=None)
        count = sum(near(w, x) for x in words)
        forms[w] = best[1] if best and -best[0] >= ratio * n else None
        rows[w] = (n, count, -best[0] if forms[w] else None)
    out = []
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, *rows[w]))
    return sorted(out)


def check(spark, words):
    df = spark.createDataFrame(list(words.items()) or [("x", 1)], "word string, n long")
    found = variants(df if words else df.limit(0)).collect()
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found) == plain(words)


def test_dense_words(spark):
    draw = random.Random(3)
    words = {"".join(draw.choice("abé") for _ in range(draw.randint(1, 6))): draw.randint(1, 40) for _ in range(400)}
    check(spark, words | {"aaaaa": 9, "aaaaaa": 9, "aaaa": 9, "aaaaaaa": 1})


def test_hubs_ties_and_long_words(spark):
    hub = {"color" + c: 5 for c in "abcdefghijklmnopqrstuvwxyzàáâãäåæ"} | {"color": 1000, "colour": 400, "dolor": 400}
    check(spark, hub | {"x" * 3000: 7, "x" * 2999: 20, "x" * 1500 + "y" + "x" * 1499: 3})
    check(spark, {})
    check(spark, {"alone": 3})


@settings(max_examples=200, deadline=None)
@given(st.text("abé", min_size=1, max_size=12), st.integers(0, 10**6))
def test_slip(word, doc_id):
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    expected = word if h % 3 else word[: h % len(word)] + word[h % len(word) + 1 :]
    assert slipped(word, str(doc_id).encode(), 3) == expected


def test_vocabulary(spark, docs):
    rows = [*ODD, (50, "Straße strasse Über ÜBER über naïve-naïve NAÏVE"), (51, None), (52, "x1y2z3 hello_hello hello")]
    rows = [r if len(r) == 3 else (*r, "s") for r in rows]
    expected = Counter()
    for i, text, _ in rows:
        name = "" if i is None else str(i)
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{name}:{w}".encode())
            w = w if h % 2 else w[: h % len(w)] + w[h % len(w) + 1 :]
            expected[w] += len(w) >= 4
    found = vocabulary(docs(rows).selectExpr("*", "text AS word"), min_chars=4, min_times=1, slip=2).collect()
    assert {r.word: r.n for r in found} == {w: n for w, n in expected.items() if n}
    assert vocabulary(docs(rows).limit(0)).count() == 0
