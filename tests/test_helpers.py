"""Small functions that mappings and callers name."""

from pyspark.sql import functions as F

from lumenfold.functions import standards
from lumenfold.functions.text import safe_name
from lumenfold.operators import answer, audit


def test_transforms_by_name(spark):
    df = spark.createDataFrame([("IS 302 to IS 304 Electric irons",), ("and IS 456:2000, (concrete)",), ("n/a",)], "c string")
    made = {name: df.select(f(F.col("c")).alias("x")).collect() for name, f in standards.TRANSFORMS.items()}
    assert set(made) == {"squeeze", "numbers", "first_number", "number_and_date", "number_and_product", "scope", "name_and_address"}
    product = [tuple(r.x) for r in made["number_and_product"]]
    assert product == [(["IS 302", "IS 304"], "Electric irons", "RANGE_ENDPOINTS_ONLY"), (["IS 456"], "concrete", ""), ([], "", "")]


def test_entities_and_names(spark):
    df = spark.createDataFrame([("IS 302, is:302 and IS 456",)], "c string")
    assert df.select(standards.norm_entity("STANDARD", F.col("c"))).first()[0] == ["IS 302", "IS 456"]
    assert df.select(standards.norm_entity("DOCUMENT", F.col("c"))).first()[0] == ["is 302 is 302 and is 456"]
    assert df.select(safe_name(F.lit(" a b/c?.csv "))).first()[0] == "a_b_c_.csv"


def test_plans_and_types(spark):
    tasks = spark.createDataFrame([("TEST_LOOKUP",), ("OTHER",)], "task string")
    assert [r.plan for r in answer.plan_steps(tasks).collect()] == ["get_tests", ""]
    decided = spark.createDataFrame([("LAB", "PASS"), ("LAB", "GAP"), ("LAB", "GAP"), ("QCO", "UNKNOWN")], "type string, decision string")
    assert {tuple(r) for r in audit.by_type(decided).collect()} == {("LAB", 1, 2, 0), ("QCO", 0, 0, 1)}
