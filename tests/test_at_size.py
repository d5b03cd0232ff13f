"""What larger tables showed: differences from SQL, and work that grew with rows where it need not."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import pandas as pd
from conftest import rows_of
from pyspark.sql import functions as F

from lumenfold.functions.text import SEARCH_STOPWORDS
from lumenfold.operators import audit, domains, vectors
from lumenfold.plans import conflicting, grouping
from lumenfold.plans.registry import everything

QUERIES, ORACLES = everything()


def compared(name, spark, folder, **tables):
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    found, expected = QUERIES[name](spark, str(folder)).toPandas(), con.execute(ORACLES[name]).df()
    assert len(found) and rows_of(found) == rows_of(expected)


def test_evidence_reads_case_as_its_sql(spark, tmp_path):
    texts = ["Mail John.Doe@example.org now", "x@Y.com", "under THE mit License", "password=AB12", "PASSWORD=ab password=0fF1", "a@b.c A@B.C"]
    compared("evidence_extract", spark, tmp_path, documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_wide_view_lists_all(spark, tmp_path):
    nation = spark.createDataFrame([(0, "A"), (1, "B")], "n_nationkey int, n_name string")
    supplier = spark.range(100000, 103000).select(F.col("id").alias("s_suppkey"), F.lit(0).alias("s_nationkey"))
    compared("wide_view", spark, tmp_path, nation=nation, supplier=supplier, customer=spark.createDataFrame([(1, "X")], "c_nationkey int, c_mktsegment string"))


def test_registry_past_five_digits(spark, tmp_path):
    pages = spark.range(134000).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), F.lit("h").alias("html"))
    compared("document_registry", spark, tmp_path, pages=pages)


def test_best_candidates_of_a_task():
    rows = [("r", f, (i * 7 % 10) / 10, f"e{i:03d}") for i in range(300) for f in ("a", None)]
    batches = [pd.DataFrame(rows[i : i + 50], columns=["requirement_id", "field", "support", "evidence_id"]) for i in range(0, 600, 50)]
    (found,) = audit._foremost(3)(iter(batches))
    expected = sorted((-s, e) for _, f, s, e in rows if f == "a")[:3]
    for field in (found[found.field == "a"], found[found.field.isna()]):
        assert sorted((-s, e) for s, e in zip(field.support, field.evidence_id, strict=True)) == expected


def test_keys_are_counted_by_what_files_hold(spark, sf):
    cells = grouping._cells(spark, sf)
    patterns = grouping._patterns(cells)
    most = patterns.groupBy("s").count().agg(F.max("count")).first()[0]
    assert most <= 40 and patterns.agg(F.sum(F.col("n") * F.size("cells"))).first() == cells.agg(F.sum(F.size("cells"))).first()


def test_names_of_columns_are_not_read_for_each_row(spark, sf):
    plan = QUERIES["discriminators"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp" in plan[: plan.index("aggregate")] and "regexp" not in plan[plan.index("aggregate") :]
    assert conflicting._shapes(spark, sf).columns[0] == "pair"


def test_texts_of_files_are_held_against_patterns_once(spark, sf, monkeypatch):
    assert "RLIKE" not in QUERIES["file_domains"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()  # only in what made the tables of different values
    files = spark.createDataFrame([(1, "QCO list", ["qco_id", None, "qco_id"], None), (2, None, None, "ISI Mark crs"), (2, "faq", ["answer"], "faq")], "file_id long, name string, headers array<string>, sample string")
    expected = {(1, "03_QCO", 5), (2, "04_SCHEME_I", 2), (2, "05_SCHEME_II_CRS", 2), (2, "12_CERTIFICATION_FAQ", 5), (2, "18_HALLMARKING_FAQ", 3)}
    assert {tuple(r) for r in domains.domain_scores(files).collect()} == expected
    few = [(d, h, []) for d, h, _ in domains.DOMAINS]
    assert {tuple(r) for r in domains.domain_scores(files, None, few, []).collect()} == {(1, "03_QCO", 3), (2, "12_CERTIFICATION_FAQ", 3), (2, "18_HALLMARKING_FAQ", 3)}
    monkeypatch.setattr(domains, "BROADCAST_BYTES", 0)  # too many to be broadcast
    assert {tuple(r) for r in domains.domain_scores(files).collect()} == expected


def _brute(rows, dims):
    """Vectors by the docstring of ``embed``, a word at a time; texts of an id are one."""
    texts = {}
    for key, text in rows:
        texts.setdefault(key, []).extend(w for w in re.findall("[a-z0-9]+", (text or "").lower()) if len(w) >= 3 and w not in SEARCH_STOPWORDS)
    df, found = Counter(w for own in texts.values() for w in set(own)), {}
    for key, own in texts.items():
        v = [0.0] * dims
        for w in own if key is not None else []:
            h = hashlib.md5(w.encode()).hexdigest()
            v[int(h[:7], 16) % dims] += (1 if h[7] < "8" else -1) * (math.log((1 + len(rows)) / (1 + df[w])) + 1)
        size = math.sqrt(sum(x * x for x in v))
        found[key] = [round(x / size, 9) + 0.0 if size else 0.0 for x in v]
    return found


def test_vectors_where_texts_lie(spark, monkeypatch):
    rows = [(i, f"Common thing word{i % 7} rare{i} rare{i} the \u00c9t\u00e9 ab") for i in range(60)]
    rows += [(5, "more common of five"), (5, None), (None, "common nobody"), (None, "nobody"), (900, None), (901, "of the")]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string").repartition(3)
    tables, put = [], vectors.written
    monkeypatch.setattr(vectors, "written", lambda df, what: tables.append(set(df.columns)) or put(df, what))
    idf, expected = vectors.fit_idf(chunks), _brute(rows, 8)
    by = lambda df: {r.chunk_id: [round(x, 9) + 0.0 for x in r.vector] for r in df.collect()}
    made = vectors.embed(chunks, idf, 8)
    assert by(made) == expected
    assert not any({"chunk_id", "word"} <= t for t in tables)  # no table of the words of texts
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate" in line and "word" in line for line in plan.splitlines())  # words of texts don't travel
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 20 * vectors.WORD_BYTES)  # rare words do where they are too many
    assert vectors._common(idf.where("word IS NOT NULL")) is not None
    assert by(vectors.embed(chunks, idf, 8)) == expected


def test_texts_are_not_ordered_with_their_shards(spark, monkeypatch):
    tables, put = {}, vectors.written
    monkeypatch.setattr(vectors, "written", lambda df, what: tables.setdefault(what, put(df, what)))
    chunks = spark.createDataFrame([(i, f"word{i % 7} thing") for i in range(40)], "chunk_id long, content string")
    vectors.refreshed(chunks, None, vectors.fit_idf(chunks), 16, 8)
    assert tables["placed"].count() == 40 and not any("content" in t.columns for t in tables.values())
