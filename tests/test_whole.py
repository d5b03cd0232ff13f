"""Registered queries read whole tables."""

import itertools
import random

from conftest import rows_of
from pyspark.sql import functions as F

from lumenfold.functions.similarity import name_class
from lumenfold.operators import compare
from lumenfold.plans.registry import everything

QUERIES, _ = everything()


def written(spark, path, **tables) -> str:
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_compare_members_reads_every_customer(spark, tmp_path):
    rows = [(1, 1, "A"), (2, 2, "A"), (900, 1, "B"), (901, 2, "C"), (902, 3, "D")]
    sf = written(spark, tmp_path, customer=(rows, "c_custkey long, c_nationkey int, c_mktsegment string"))
    found = QUERIES["compare_members"](spark, sf).select("member", "in_a", "in_b").toPandas()
    # columns by name: in_a, in_b, member
    assert rows_of(found) == [("False", "True", "C"), ("True", "False", "B"), ("True", "True", "A")]


def test_file_coverage_reads_every_order(spark, tmp_path):
    rows = [(1, 1, 7), (2, 1, 8), (3, 2, 7), (40, 2, 7), (41, 3, 9)]
    sf = written(spark, tmp_path, lineitem=(rows, "l_orderkey long, l_linenumber int, l_suppkey long"))
    found = QUERIES["file_coverage"](spark, sf).orderBy("file_id").select("file_id", "n_keys", "unique_keys", "best_cover", "covered", "residual_free").collect()
    assert [tuple(r) for r in found] == [("F1", 2, 1, "F2", 0.5, False), ("F2", 1, 0, "F1", 1.0, True), ("F3", 1, 1, None, 0.0, False)]


def test_name_similarity_finds_pairs_at_any_distance(spark, tmp_path):
    rows = [(1, "red bolt"), (2, "blue rod"), (500, "red bolt"), (900, "Bolts, red"), (901, "red gear"), (902, None), (903, "the")]
    sf = written(spark, tmp_path, part=(rows, "p_partkey long, p_name string"))
    found = {(r["id_a"], r["id_b"]): r["cls"] for r in QUERIES["name_similarity"](spark, sf).collect()}
    assert found == {(1, 500): "EXACT_DUPLICATE", (1, 900): "LIKELY_DUPLICATE"}


def test_similar_names_are_those_of_all_pairs(spark):
    draw = random.Random(5)
    names = sorted({" ".join(f"w{int(draw.paretovariate(0.7)) % 25}" for _ in range(draw.randint(1, 7))) for _ in range(120)})
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    every = spark.createDataFrame([(i, j, names[i], names[j]) for i, j in itertools.combinations(range(len(names)), 2)], "a long, b long, x string, y string")
    expected = every.select("a", "b", name_class(F.col("x"), F.col("y"))["cls"].alias("cls")).where("cls <> 'DIFFERENT_ENTITY'").collect()
    found = compare.similar_names(df, "id", "name").select("id_a", "id_b", "cls").collect()
    assert len(found) > 100
    assert sorted(map(tuple, found)) == sorted(map(tuple, expected))


def test_row_duplicates_compares_whole_rows(spark, tmp_path):
    rows = [(1, "a b", "en", "s", 3), (2, "c", "en", "s", 1), (9, "a b", "en", "s", 3), (10, "a b", "de", "s", 3), (11, "a b", "en", "t", 3)]
    sf = written(spark, tmp_path, documents=(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    found = QUERIES["row_duplicates"](spark, sf).select("n_rows", "first_row", "last_row").collect()
    assert [tuple(r) for r in found] == [(2, 1, 9)]
