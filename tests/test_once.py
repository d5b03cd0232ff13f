"""Functions of a cell read it by few patterns: none is matched anew for each place that its result goes to."""

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import standards, values

FUNCTIONS = {
    "first_number": (standards.first_number, 12), "distinct_numbers": (standards.distinct_numbers, 12), "split_list": (values.split_list, 40), "ndate": (values.ndate, 30),
    "number_and_date": (standards.split_number_and_date, 30), "scope": (standards.split_scope, 12), "name_and_address": (standards.split_name_and_address, 40),
}


@pytest.mark.parametrize("name", sorted(FUNCTIONS))
def test_patterns_are_few(name, spark):
    f, most = FUNCTIONS[name]
    df = spark.createDataFrame([("IS 302",)], "c string").select(f(F.col("c")).alias("x"))
    plan = df._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("regexp_") + plan.count("rlike") <= most


def test_lists_with_and_without_brackets(spark):
    rows = [("a b; c (d, e), A B|f",), ("x, y; z, X",), ("),q;(b",), ("one of these; and that, the other",), ("n/a",), (None,)]
    found = [r.x for r in spark.createDataFrame(rows, "c string").select(values.split_list(F.col("c")).alias("x")).collect()]
    assert found == [["a b", "c (d, e)", "f"], ["x", "y", "z"], [")", "q", "(b"], ["one of these", "and that, the other"], [], []]
