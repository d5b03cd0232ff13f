"""The queries against their SQL, and every operator on odd rows and empty tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from lumenfold.llm import decontaminate, jaccard_join, language_id, license_scan, line_dedup, mixing, pii, quality_classifier, quality_rules, sharding
from lumenfold.llm.queries import oracle_sql, queries

from .conftest import ODD, SCHEMA
from .test_jaccard_join import brute
from .test_matching import plain_spans

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def ran(spark, sf):
    """The rows of a query, which runs once."""
    held: dict = {}

    def rows(name):
        if name not in held:
            held[name] = QUERIES[name](spark, sf).collect()
        return held[name]

    return rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(name, spark, sf, duck):
    found = QUERIES[name](spark, sf).toPandas()
    expected = duck.execute(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows_of(found) == rows_of(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op5_decontaminate"}))
def test_one_row_each(name, spark, sf, ran):
    ids = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").toPandas()
    assert sorted(r.doc_id for r in ran(name)) == sorted(ids.doc_id)


def operators(spark):
    labels = spark.createDataFrame([(5, 1), (6, 0), (7, None), (None, 1)], "doc_id long, quality int")
    items = spark.createDataFrame([(0, "same text in two rows same text"), (1, None), (2, "")], "item_id long, text string")
    return {
        "license": lambda d: license_scan.scan_licenses(d.select("doc_id", "text")),
        "jaccard": lambda d: jaccard_join.jaccard_components(d),
        "sharding": lambda d: sharding.shards(d),
        "language": lambda d: language_id.label_languages(d.select("doc_id", "text"), language_id.learn(d.withColumn("lang", F.col("source")))),
        "classifier": lambda d: quality_classifier.quality_scores(d.select("doc_id", "text"), labels),
        "mixing": lambda d: mixing.mix(d),
        "pii": lambda d: pii.find_pii(d.select("doc_id", "text"), pii.learn(d)),
        "lines": lambda d: line_dedup.dedup_lines(d, min_docs=2),
        "rules": lambda d: quality_rules.quality_rules(d),
        "leaks": lambda d: decontaminate.matches(d, items),
    }


#: Names that operators use themselves, and names that need quoting.
CLASHING = ["key", "keys", "rid", "host", "row", "bytes", "kept", "size", "draw", "times", "copy", "group", "node", "id", "md5", "doc_ids", "__id", "__leak", "__gone", "__key", "a.b", "two words"]


@pytest.mark.parametrize("name", ["license", "jaccard", "sharding", "language", "classifier", "mixing", "pii", "lines", "rules"])
def test_odd_rows(name, spark, docs):
    clash = docs(ODD)
    for extra in (*CLASHING, "score", "shard", "spans", "n_words", "labels", "Taken"):
        clash = clash.withColumn(extra, F.lit(1))
    run = operators(spark)[name]
    assert run(clash).count() == len(ODD)
    assert run(clash.limit(0)).count() == 0


#: The rows of ODD that each stage keeps, by (doc_id, text) where both count.
STAYS = {
    "quality rules": lambda rows: [],
    "near duplicates": lambda rows: [r for i, r in enumerate(rows) if i not in (6, 7)],
    "decontamination": lambda rows: rows,
    "mixing": None,
    "sharding": lambda rows: rows,
}


@pytest.mark.parametrize("stage", ["quality rules", "near duplicates", "decontamination", "mixing", "sharding"])
def test_stages_keep_columns(stage, spark, docs, sf):
    import corpus_pipeline

    run = dict(corpus_pipeline.STAGES)[stage]
    rows = [(*r, i) for i, r in enumerate(ODD)]
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", len(r[1] or ""), i) for i, r in enumerate(ODD)]
    clash = spark.createDataFrame(full, SCHEMA + ", nth int")
    for extra in CLASHING:
        clash = clash.withColumn(extra, F.concat(F.lit(extra), F.col("nth").cast("string")))
    out = run(spark, clash, sf)
    assert out.columns == clash.columns + ["shard"] * (stage == "sharding")
    found = out.collect()
    for r in found:  # every row has its own values still
        assert all(r[extra] == f"{extra}{r['nth']}" for extra in CLASHING)
        assert (r["doc_id"], r["text"]) == (rows[r["nth"]][0], rows[r["nth"]][1])
    if STAYS[stage]:
        expected = STAYS[stage](list(range(len(rows))))
        repeated = {5, 6} if stage == "near duplicates" else set()  # equal in id and text: either may stay
        assert {n for n in (r["nth"] for r in found) if n not in repeated} == {n for n in expected if n not in repeated}
        assert sum(r["nth"] in repeated for r in found) == bool(repeated)
    assert run(spark, clash.limit(0), sf).count() == 0


def test_one_row_stays_of_rows_with_one_id(spark, docs):
    words = "alpha beta gamma delta epsilon zeta".split()
    rows = [(1, " ".join(words)), (7, " ".join(words)), (7, "quite another text that stands on its own"), (8, "quite another text that stands on its own"), (None, " ".join(words)), (None, "a third one without any id at all")]
    kept = jaccard_join.one_of_each(docs(rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[0], rows[2], rows[5]], key=str)


def test_odd_leaks(spark, docs):
    found = operators(spark)["leaks"](docs(ODD)).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in found) == [(4, 0, 0), (4, 0, 0), (5, 0, 0)]
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(docs(ODD), empty).count() == 0
    assert decontaminate.without_leaks(docs(ODD), spark.createDataFrame([(0, "null id here")], "item_id long, text string")).count() == len(ODD) - 1


def plain_texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def test_op1_base(spark, sf, ran):
    texts = plain_texts(spark, sf)
    phrases = [("gnu general public license".split(), "gpl"), ("apache license".split(), "apache"), ("cc by".split(), "cc-by"), ("mit license".split(), "mit")]
    for r in ran("op1_license_scan"):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(texts[r.doc_id]))
        places = sorted((i, label) for p, label in phrases for i in range(len(w)) if w[i : i + len(p)] == p)
        first, last = (places[0][0], places[-1][0]) if places else (None, None)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), first, last, ",".join(sorted({x for _, x in places})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_op3_columns(spark, sf, ran):
    texts = plain_texts(spark, sf)
    found = pd.DataFrame([r.asDict() for r in ran("op3_sharding")])
    for r in found.itertuples():
        b = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(b) + 16, zlib.crc32(b), "bytes")
    for _, part in found.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert found.assign(t=found.doc_id.map(texts)).groupby("t").shard.nunique().max() == 1
    groups = found.assign(t=found.doc_id.map(texts)).groupby("t")["size"].sum()
    loads = found.groupby("shard")["size"].sum().reindex(range(40), fill_value=0)
    fair = loads.sum() / 40
    assert loads.max() <= max(groups.max(), 1.1 * fair)


def test_op4_columns(spark, sf, ran):
    texts = plain_texts(spark, sf)
    langs = {r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang").distinct().collect()} - {None}
    for r in ran("op4_language_id"):
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if any(c.isalpha() for c in texts[r.doc_id]):
            assert r.lang_pred in langs and 0 < r.score <= 1
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)


def test_op6_columns(spark, sf, ran):
    for r in ran("op6_quality_classifier"):
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_op7_columns(spark, sf, ran):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    source = {r.doc_id: r.source for r in rows}
    whole = Counter()
    for i, n in size.items():
        whole[source[i]] += n
    names = sorted((s for s in whole if s is not None), key=lambda s: s.encode()) + [None] * (None in whole)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = sum(whole.values()) - sum(3 * whole[s] for s in full)
        open_ = [s for s in names if s not in full]
        target = {s: 3.0 * whole[s] if s in full else rest * weight[s] / sum(weight[x] for x in open_) for s in names}
        over = {s for s in open_ if target[s] > 3 * whole[s]}
        if not over:
            break
        full |= over
    taken = Counter()
    for r in ran("op7_mixing"):
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == whole[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        taken[s] += r.taken
    for s in names:  # a proportional part of each length, then the best sum of the rest from below
        counts = Counter(n for i, n in size.items() if source[i] == s)
        epochs = int(target[s] // whole[s]) if whole[s] else 0
        budget = round(target[s]) - epochs * whole[s]
        part = {n: c * budget // max(1, whole[s]) for n, c in counts.items()}
        fixed, reach = sum(n * c for n, c in part.items()), {0}
        for n, c in counts.items():
            reach = {r + n * i for r in reach for i in range(c - part[n] + 1)}
        assert taken[s] == epochs * whole[s] + max(fixed + r for r in reach if fixed + r <= budget)


def test_op8_columns(spark, sf, ran):
    texts = plain_texts(spark, sf)
    kinds = ["email", "ip", "card", "phone"]
    for r in ran("op8_pii"):
        base = [f"{kinds[k]}:{a}:{b}" for k, a, b in plain_spans(texts[r.doc_id])]
        counts = Counter(x.split(":")[0] for x in base)
        assert [r[f"n_{k}"] for k in kinds] == [counts[k] for k in kinds]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(base) <= set(spans) and len(spans) == r.n_spans


def test_pipeline_brute_force(spark, sf):
    """Each stage of the whole run against a plain version, on a small table."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, decontaminate.normalise(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "mixing", "sharding"]
    held = {name: None for name, _ in corpus_pipeline.STAGES}
    rows = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame(rows, docs.schema), sf)
        assert out.columns == docs.columns + ["shard"] * (name == "sharding")
        found = out.collect()
        held[name] = Counter(r.doc_id for r in found)
        ids = {r.doc_id: r.text or "" for r in rows}
        if name == "quality rules":
            failed = {i: plain_failed(t) for i, t in ids.items()}
            by_host: dict = {}
            for r in rows:
                by_host.setdefault(r.source, []).append(failed[r.doc_id])
            bad = plain_rejected(by_host)
            assert held[name] == Counter(r.doc_id for r in rows if not failed[r.doc_id] and r.source not in bad)
        elif name == "near duplicates":
            assert set(held[name]) == {c for _, _, c in brute(sorted((i, t) for i, t in ids.items()))}
        elif name == "decontamination":
            texts = {i: decontaminate.normalise(t) for i, t in ids.items()}
            exact = {i for i, t in texts.items() if any(x and x in t for _, x in items)}
            assert not exact & set(held[name])
            assert set(held[name]) == {i for i, t in texts.items() if not any(x and within(x, t, int(len(x) * decontaminate.MAX_ERROR)) for _, x in items)}
        elif name == "mixing":
            assert held[name] == plain_mix(spark, spark.createDataFrame(rows, docs.schema))
        else:
            assert held[name] == Counter(r.doc_id for r in rows) and {r.shard for r in found} <= set(range(40))
            assert len({(r.text, r.shard) for r in found}) == len({r.text for r in found})
        rows = [r[: len(docs.columns)] for r in found]
        rows = spark.createDataFrame(rows, docs.schema).collect()


def plain_failed(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(8)}
    return len(w) < 20 or 100 * len(covered) > 30 * len(w)


def within(item, text, most):
    """Whether the item is somewhere in the text with so many edits, by the plain table of distances."""
    if item in text:
        return True
    a = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    row = np.zeros(len(a) + 1, np.int32)
    steps = np.arange(len(a) + 1, dtype=np.int32)
    for i, c in enumerate(np.frombuffer(item.encode("utf-32-le"), np.uint32), 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (a != c))
        best = np.concatenate([[i], best])
        row = np.minimum.accumulate(best - steps) + steps  # one character of the text put in after another
        if row.min() > most:
            return False
    return bool(row.min() <= most)


def plain_rejected(by_host):
    """Hosts by their rates, shrunk by a beta prior that is fitted to all rates by moments."""
    n = {h: len(f) for h, f in by_host.items()}
    rate = {h: sum(f) / len(f) for h, f in by_host.items()}
    mean = sum(map(sum, by_host.values())) / sum(n.values())
    var = float(np.var(list(rate.values())))
    spread = max(var - mean * (1 - mean) * sum(1 / x for x in n.values()) / len(n), 0)
    most = quality_rules.MAX_PRIOR_DOCS
    weight = most if spread <= 0 else max(1, min(most, mean * (1 - mean) / spread - 1))
    return {h for h, f in by_host.items() if (sum(f) + mean * weight) / (len(f) + weight) >= quality_rules.HOST_MAX_RATE}


def plain_targets(whole):
    """Targets of sources by their words: weights 1, 2, 3 in turn, none above three times its source."""
    names = sorted((s for s in whole if s is not None), key=lambda s: s.encode()) + [None] * (None in whole)
    weight, full = {s: 1 + i % 3 for i, s in enumerate(names)}, set()
    while True:
        rest = sum(whole.values()) - sum(3 * whole[s] for s in full)
        left = [s for s in names if s not in full]
        target = {s: 3.0 * whole[s] if s in full else rest * weight[s] / sum(weight[x] for x in left) for s in names}
        over = {s for s in left if target[s] > 3 * whole[s]}
        if not over:
            return target
        full |= over


def plain_mix(spark, docs):
    """How often each document is taken: those of the least draw of each length, as many as the budget's knapsack says."""
    draw = F.xxhash64(F.lit(mixing.SEED), F.col("doc_id").cast("string"), "text").alias("draw")
    rows = [(r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.source, r.draw) for r in docs.select("doc_id", "text", "source", draw).collect()]
    whole = Counter()
    for _, n, source, _ in rows:
        whole[source] += n
    target, times = plain_targets(whole), Counter()
    for source in whole:
        own = [r for r in rows if r[2] == source]
        epochs = int(target[source] // whole[source]) if whole[source] else 0
        sizes = sorted({r[1] for r in own})
        extra = mixing.fit(np.array(sizes), np.array([sum(r[1] == n for r in own) for n in sizes]), round(target[source]) - epochs * whole[source])
        for n, k in zip(sizes, extra.tolist(), strict=True):
            for i, r in enumerate(sorted((r for r in own if r[1] == n), key=lambda r: r[3])):
                times[r[0]] += (epochs + (i < k)) if n else 1
    return +times


def test_op5_brute_force(spark, sf, ran):
    """Every document against every item by the plain table of edit distances."""
    items = [(r.item_id, decontaminate.normalise(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {i: decontaminate.normalise(t) for i, t in plain_texts(spark, sf).items()}
    expected = {(i, item_id) for i, t in texts.items() for item_id, x in items if x and within(x, t, int(len(x) * decontaminate.MAX_ERROR))}
    found = {(r.doc_id, r.item_id) for r in ran("op5_decontaminate")}
    assert found == expected and expected


def test_op5_many_blocks(spark, sf, ran, monkeypatch):
    """As many blocks as items are one stage and find the same."""
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 1)
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    assert len(list(decontaminate.item_blocks(items))) >= 20
    found = decontaminate.matches(docs, items)
    assert found._jdf.queryExecution().toString().count("MapInArrow") <= 4  # the plan in its four forms
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, ran("op5_decontaminate")))
    left = decontaminate.without_leaks(docs, items)
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in docs.collect()} - {r.doc_id for r in ran("op5_decontaminate")}


def test_op4_plain_scores(spark, sf, ran):
    """Labels and scores against a plain best path, word by word, over the learnt weights."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.learn(docs.where(~language_id.held_out(3, 1)).select("doc_id", "text", "lang"))
    got = {r.doc_id: r for r in ran("op4_language_id")}
    for i, text in plain_texts(spark, sf).items():
        words = language_id.words_of(text)
        if not words:
            continue
        scores = model.scores(words)
        best, back = scores[0].astype(np.float64), []
        for s in scores[1:]:
            top = int(best.argmax())
            stay = best >= best[top] - language_id.SWITCH
            back.append(np.where(stay, np.arange(len(best)), top))
            best = np.where(stay, best, best[top] - language_id.SWITCH) + s
        path = [int(best.argmax())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        votes = Counter(path)
        if len(votes) == 1:  # of ties between paths either is right
            assert got[i].lang_pred == model.langs[path[0]] and got[i].score == 1.0
        else:
            assert abs(got[i].score - max(votes.values()) / len(path)) < 0.05


def test_op6_plain_scores(spark, sf, ran):
    """Scores against the rules, applied one by one to statistics."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    own = labels.where(~quality_classifier.held_out(4, 2))
    model = quality_classifier.RuleEnsemble.fit(*quality_classifier.training_rows(docs, own))
    rows = quality_classifier.with_statistics(docs.select("doc_id", "text"), "text").toPandas()
    stats = rows[quality_classifier.STATISTICS].to_numpy(np.float64)
    total = np.full(len(rows), model.intercept)
    for rule, w in model.rules:
        total += w * quality_classifier.holds(rule, stats)
    expected = dict(zip(rows["doc_id"], 1 / (1 + np.exp(-total)), strict=True))
    assert all(abs(r.score - expected[r.doc_id]) < 1e-9 for r in ran("op6_quality_classifier")) and model.rules


def test_samples_are_of_different_texts(spark, docs):
    """One labelled id with many rows, and copies under many ids, are one text each."""
    many = [(1, f"text number {i} of one id") for i in range(300)] + [(i, "one text under many ids") for i in range(2, 300)] + [(1000, "a last text")]
    labels = spark.createDataFrame([(1, 1), *((i, i % 2) for i in range(2, 300)), (1000, 0)], "doc_id long, quality int")
    x, y = quality_classifier.training_rows(docs(many), labels, most=50)
    assert len(x) == len(y) == 50
    x, y = quality_classifier.training_rows(docs(many), labels, most=5000)
    assert len(x) == 300 + 2 + 1
    model = language_id.learn(docs(many).withColumn("lang", F.when(F.col("doc_id") == 1000, "b").otherwise("a")))
    assert model.langs == ["a", "b"]


def test_op9_keys_to_filters(spark, sf, ran):
    """Filters that are not broadcast find the same, with one Python stage that splits texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "x" * 100 + "\n" * 50)], "doc_id long, text string")
    docs = docs.unionByName(odd).withColumn("chunk", F.lit("c")).withColumn("key", F.lit(1))
    index = line_dedup.LineIndex.of(docs, shards=32)
    here, there = (line_dedup.drop_common_lines(docs, index, most=m) for m in (line_dedup.BROADCAST_BYTES, 0))
    assert here.columns == there.columns
    assert sorted(map(tuple, here.collect()), key=str) == sorted(map(tuple, there.collect()), key=str)
    assert here.where("n_dropped > 0").count() > 0
    assert line_dedup.drop_common_lines(docs.limit(0), index, most=0).count() == 0


def test_hot_text_is_split(spark, docs, monkeypatch):
    """A text in half of all rows, where facts are too many to be broadcast, still is in one shard."""
    from lumenfold import storage

    rows = [(i, "copied text" if i % 2 else f"text {i}") for i in range(3000)]
    expected = {r.doc_id: r.shard for r in sharding.shards(docs(rows)).collect()}
    kept = {r.doc_id: r.shard for r in sharding.with_shard(docs(rows)).collect()}
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 0)
    assert {r.doc_id: r.shard for r in sharding.shards(docs(rows)).collect()} == expected
    assert {r.doc_id: r.shard for r in sharding.with_shard(docs(rows)).collect()} == kept == expected
    assert len({expected[i] for i in range(1, 3000, 2)}) == 1
