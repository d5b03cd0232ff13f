"""The Jaccard join against brute force, light and heavy sets, hot groups."""

import random

import pytest

from lumenfold.llm import jaccard_join


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both, union = len(sets[a][1] & sets[b][1]), len(sets[a][1] | sets[b][1])
            if both and 100 * both >= 75 * union:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(s), least[find(k)] if s else i) for k, (i, s) in enumerate(sets))


def corpus(seed, n, words):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(*words))] for _ in range(n // 4)]
    out = []
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
            if text:
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            text = text[: rng.randint(1, len(text))]
        out.append((i, " ".join(text)))
    return out


def test_brute_force(spark, docs):
    rows = [(1000 * k + i, t) for k, words in enumerate([(1, 16), (10, 60), (40, 200)]) for i, t in corpus(words[1], 160, words)]
    found = jaccard_join.jaccard_components(docs(rows)).collect()
    assert sorted(tuple(r) for r in found) == brute(rows)


@pytest.mark.parametrize("most", [0, 4, 12])
def test_any_boundary(spark, docs, monkeypatch, most):
    monkeypatch.setattr(jaccard_join, "boundary", lambda nodes: most)
    rows = corpus(7, 160, (1, 40))
    found = jaccard_join.jaccard_components(docs(rows)).collect()
    assert sorted(tuple(r) for r in found) == brute(rows)


def test_hot_group(spark, docs):
    rng = random.Random(3)
    text = [f"t{i}" for i in range(80)]
    rows = [(i, " ".join(text)) for i in range(40)]
    for i in range(40, 200):
        copy = list(text)
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(80)] = f"edit{i}{rng.random()}"
        rows.append((i, " ".join(copy)))
    found = jaccard_join.jaccard_components(docs(rows)).collect()
    assert sorted(tuple(r) for r in found) == brute(rows)


def test_one_of_each(spark, docs):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words than those before it"), (3, "other words than those before it"), (None, "x y"), (4, None)]
    kept = jaccard_join.one_of_each(docs(rows)).select("doc_id").collect()
    assert sorted((r[0] for r in kept), key=str) == sorted([1, 3, 4, None], key=str)
