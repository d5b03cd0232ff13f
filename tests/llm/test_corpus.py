"""Sharding, mixing, lines, languages, quality: laws and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import language_id, line_dedup, mixing, quality_classifier, quality_rules, sharding
from lumenfold.llm.components import components


def test_differencing_balances():
    rng = np.random.default_rng(0)
    for k in (2, 5, 40):
        sizes = rng.integers(1, 10_000, 400)
        loads = np.zeros((len(sizes), k), np.int64)
        loads[:, -1] = sizes
        total, slots = sharding.difference(loads)
        sums = np.bincount(slots[:, -1], sizes, k)
        assert sorted(sums) == sorted(total)
        assert sums.max() - sums.min() <= sizes.max() * 0.2


@pytest.mark.parametrize("bucket", [10_000, 150])
@pytest.mark.parametrize("hot", [0, 60])
def test_shards(spark, docs, bucket, hot, monkeypatch):
    monkeypatch.setattr(sharding, "LARGE", 2)
    rng = random.Random(1)
    texts = ["x" * rng.randint(1, 3000) for _ in range(600)] + ["y" * rng.randint(1, 90) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, "hot " * 400) for i in range(hot)]
    groups = sharding.assign
    monkeypatch.setattr(sharding, "assign", lambda g, n=40: groups(g, n, bucket))
    out = sharding.shards(docs(rows)).toPandas()
    assert len(out) == len(rows)
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    text = dict(rows)
    out["text"] = out.doc_id.map(text)
    assert out.groupby("text").shard.nunique().max() == 1
    loads = out.groupby("shard")["size"].sum().reindex(range(40), fill_value=0)
    if hot:
        loads = loads.drop(out[out.doc_id == 1000].shard.iloc[0])
    # a last bucket of few groups evens out to within the largest group
    assert loads.max() <= max(1.02 * loads.mean(), (loads.mean() + 3016) * (bucket < 1000))


def test_subset_sums():
    rng = random.Random(2)
    for _ in range(200):
        lengths = np.array(sorted(rng.sample(range(1, 60), 6)))
        counts = np.array([rng.randint(0, 4) for _ in lengths])
        total = int((lengths * counts).sum())
        budget = rng.randint(0, total)
        took = mixing.fit(lengths, counts, budget)
        assert ((0 <= took) & (took <= counts)).all()
        reach = {0}
        for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            reach = {r + n * i for r in reach for i in range(c + 1)}
        # a proportional part is taken before the table, so the sum is the best beside that part
        assert int((lengths * took).sum()) <= budget
        part = counts * budget // max(1, total)
        rest = {0}
        for n, c in zip(lengths.tolist(), (counts - part).tolist(), strict=True):
            rest = {r + n * i for r in rest for i in range(c + 1)}
        fixed = int((lengths * part).sum())
        assert int((lengths * took).sum()) == max(fixed + r for r in rest if fixed + r <= budget)


def test_mix(spark, docs):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "b", "c", None] + ["big"] * 8)) for i in range(800)]
    out = mixing.mix(docs(rows)).toPandas()
    assert (out.taken <= 3 * out["size"]).all()
    by = out.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "max"), taken=("taken", "sum"))
    assert abs(by.target.sum() - by["size"].sum()) < 1e-6
    assert (by.target <= 3 * by["size"] + 1e-9).all()
    assert ((by.taken - by.target).abs() <= 1).all()
    again = mixing.mix(docs(rows)).toPandas()
    assert sorted(out.itertuples(index=False, name=None), key=str) == sorted(again.itertuples(index=False, name=None), key=str)
    total = mixing.mixed(docs(rows))
    assert total.select(F.sum(mixing.n_words())).first()[0] == out.taken.sum()


def test_cuckoo():
    rng = random.Random(4)
    keys = [rng.randbytes(16) for _ in range(3000)]
    made = line_dedup.CuckooFilter.of(keys[:2000])
    assert all(k in made for k in keys[:2000])
    assert sum(k in made for k in keys[2000:]) < 20
    again = line_dedup.CuckooFilter(cells=made.to_bytes())
    assert all(k in again for k in keys[:2000])
    assert all(again.delete(k) for k in keys[:1000])
    assert all(k in again for k in keys[1000:2000])
    assert sum(k in again for k in keys[:1000]) < 20


def test_line_index_is_reversible(spark, docs):
    a = docs([(i, f"common line\nown {i}\n Common LINE ") for i in range(6)])
    b = docs([(i, f"common line\nother\nmore {i}") for i in range(10, 14)] + [(20 + i, f"new {j}") for i in range(7) for j in range(40)])
    index = line_dedup.LineIndex.of(a, min_docs=7, shards=4)
    both = index.insert(b)
    back = both.delete(b)
    key = lambda x: sorted((r.shard, bytes(r.key), r.docs) for r in x.counts.collect())
    assert key(back) == key(index) and key(both) == key(line_dedup.LineIndex.of(a.union(b), min_docs=7, shards=4))
    keys = [line_dedup.line_key(x) for x in [b"common line", b"other", *(b"new %d" % j for j in range(40)), *(b"more %d" % j for j in range(40))]]
    held = lambda x: line_dedup.FilterBlock({s: bytes(c) for s, c, _ in x.filters.collect()}, set(), 4).hits(keys).tolist()
    assert not any(held(index)) and not any(held(back))  # the filters' answers are restored
    assert held(both) == [True, False] + [True] * 40 + [False] * 40
    kept = line_dedup.drop_common_lines(a, both).select("text", "n_lines", "n_dropped").collect()
    assert {(r.text.split(" ")[0], r.n_lines, r.n_dropped) for r in kept} == {("own", 3, 2)}
    assert line_dedup.drop_common_lines(a, index).where("n_dropped > 0").isEmpty()


def test_lines_without_broadcast_filters(spark, docs):
    texts = docs([(i, f"common {i % 3}\nshared\nown {i}\nshared") for i in range(30)] + [(99, None), (100, "shared")])
    whole = sorted(line_dedup.dedup_lines(texts).select("doc_id", "text", "n_lines", "n_dropped").collect())
    found = line_dedup.drop_common_lines(texts, line_dedup.LineIndex.of(texts), most=0)
    assert sorted(found.select("doc_id", "text", "n_lines", "n_dropped").collect()) == whole
    assert {(r.text, r.n_dropped) for r in whole if r.doc_id > 90} == {("", 0), ("", 1)}
    assert all((r.text, r.n_lines, r.n_dropped) == (f"own {r.doc_id}", 4, 3) for r in whole if r.doc_id < 90)


def test_false_hits_stay():
    key = line_dedup.line_key(b"common")
    shard = line_dedup.shard_of(key)
    made = line_dedup.CuckooFilter.of([key])
    assert line_dedup.FilterBlock({shard: made.to_bytes()}, set()).common([key]) == {key}
    assert line_dedup.FilterBlock({shard: made.to_bytes()}, {key}).common([key]) == set()


def test_many_languages():
    rng = np.random.default_rng(8)
    scores = rng.normal(size=(5, 200)).astype(np.float32)
    scores[:, 150] = 9
    assert set(language_id.viterbi(scores, np.array([0]), np.array([5])).tolist()) == {150}


def test_words_without_letters_follow_their_neighbours(spark, docs):
    en, ru = "the quick brown fox jumps over the lazy dog again", "быстрая лиса прыгает через ленивую собаку снова"
    learnt = language_id.learn(docs([(1, en * 3), (2, ru * 3 + " — – …")]).withColumn("lang", F.when(F.col("doc_id") == 1, "en").otherwise("ru")))
    row = language_id.label_languages(docs([(1, f"{en} " + "— – … " * 20)]).select("doc_id", "text"), learnt).first()
    assert row.lang_pred == "en" and row.score == 1.0


def test_viterbi_brute_force():
    from itertools import product

    rng = np.random.default_rng(5)
    lengths = np.array([6, 4, 1])
    scores = rng.normal(size=(lengths.sum(), 3)).astype(np.float32)
    starts = np.array([0, 6, 10])
    path = language_id.viterbi(scores, starts, lengths, switch=0.7)
    for s, n in zip(starts, lengths, strict=True):
        def value(p, s=s):
            return sum(scores[s + i, c] for i, c in enumerate(p)) - 0.7 * sum(x != y for x, y in zip(p, p[1:], strict=False))

        assert abs(value(path[s : s + n]) - max(map(value, product(range(3), repeat=int(n))))) < 1e-4


def test_languages_held_out(spark, sf):
    found = language_id.op4_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.95


def test_mixed_spans(spark, docs):
    en, ru = "the quick brown fox jumps over the lazy dog again", "быстрая лиса прыгает через ленивую собаку снова"
    learnt = language_id.learn(docs([(1, en * 3), (2, ru * 3)]).withColumn("lang", F.when(F.col("doc_id") == 1, "en").otherwise("ru")))
    row = language_id.label_languages(docs([(1, f"{en} {ru} {en}")]).select("doc_id", "text"), learnt).first()
    assert [s.lang for s in row.spans] == ["en", "ru", "en"]
    assert row.lang_pred == "en"


def test_quality_held_out(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = quality_classifier.op6_quality_classifier(spark, sf).join(labels, "doc_id").toPandas()
    held = found[found.held_out]
    assert ((held.predicted == held.quality).mean()) > 0.9


def test_rules_column_is_the_model(spark, docs):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["word", "Thing", "###", "|"]) for _ in range(rng.randint(5, 60)))) for i in range(120)]
    x = np.array([quality_classifier.statistics(t.encode()) for _, t in rows])
    share = x[:, quality_classifier.STATISTICS.index("symbol_share")]
    y = (share < np.median(share)).astype(float)
    model = quality_classifier.RuleEnsemble.fit(x, y)
    got = quality_classifier.with_statistics(docs(rows).select("doc_id", "text")).withColumn("score", model.column()).orderBy("doc_id").toPandas().score.to_numpy()
    z = model.intercept + sum(w * quality_classifier.holds(r, x) for r, w in model.rules)
    assert np.allclose(got, 1 / (1 + np.exp(-z)))
    assert ((got > 0.5) == (y == 1)).mean() > 0.95


def test_hosts_are_shrunk(spark, docs):
    rows = [(i, "bad " * 5, "junk.example") for i in range(200)] + [(1000 + i, " ".join(f"w{i}x{j}" for j in range(40)), "good.example") for i in range(200)] + [(5000, "bad", "one.example"), (5001, " ".join(f"z{j}" for j in range(40)), "junk.example")]
    found = {r.doc_id: r for r in quality_rules.quality_rules(docs(rows)).collect()}
    assert not found[5001].base_failed and not found[5001].kept and found[5001].host_rejected
    assert found[1000].kept
    assert found[5000].host_rate < 1
    kept = quality_rules.keep_good(docs(rows))
    assert kept.count() == 200 and kept.columns == docs([]).columns


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 102: 100}
