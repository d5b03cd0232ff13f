"""Edge cases of the scalar layer."""

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import standards, text, values


def one(spark, f, v):
    return spark.createDataFrame([(v,)], "v string").select(f(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "f,v,expected",
    [
        (text.norm_header, "﻿IS  Number (raw) ", "is_number_raw"),
        (text.norm_header, None, ""),
        (text.norm_cell, " 007 ", "7"),
        (text.norm_cell, "2.0", "2"),
        (text.norm_cell, "3.50", "3.5"),
        (text.norm_cell, "N/A", ""),
        (text.norm_cell, "Hello  World", "hello world"),
        (text.null_class, None, "NULL_UNKNOWN"),
        (text.null_class, "NaN", "NULL_UNKNOWN"),
        (text.null_class, "Nil", "ASSERTED_ABSENCE"),
        (text.null_class, "N.A.", "AMBIGUOUS_REQUIRES_REVIEW"),
        (text.null_class, "Steel", "POPULATED"),
        (text.stem, "batteries", "battery"),
        (text.stem, "boxes", "box"),
        (text.stem, "buses", "bu"),
        (text.redact_url, "https://u:p@h/x", "https://***@h/x"),
        (text.name_family, "Report_v2 (1).xlsx", "report"),
        (values.norder, "Not stated", "Not stated"),
        (values.norder, "s.o 294 ( e ) no: 5", "S.O. 294(E) No. 5"),
        (values.nnotification, "No. 5 2023 / 24", "No. 5 2023-24"),
        (values.nmandatory, "Mandatory / Voluntary", "BOTH"),
        (values.nname, " a / b .", "a/b"),
    ],
)
def test_scalar(spark, f, v, expected):
    assert one(spark, f, v) == expected


@pytest.mark.parametrize(
    "v,iso,precision,flag",
    [
        ("12/03/2026", "2026-03-12", "DAY", "AMBIGUOUS_DMY"),
        ("03/25/2026", "2026-03-25", "DAY", ""),
        ("Mar 2024", "2024-03", "MONTH", ""),
        ("2021", "2021", "YEAR", ""),
        ("1/2/49", "2049-02-01", "DAY", "AMBIGUOUS_DMY"),
        ("1/2/50", "1950-02-01", "DAY", "AMBIGUOUS_DMY"),
        ("31/02/2026", "2026-02-31", "DAY", ""),
        ("soon", "", "NONE", "UNPARSED_PRESERVED"),
        (None, "", "", ""),
    ],
)
def test_dates(spark, v, iso, precision, flag):
    d = one(spark, values.ndate, v)
    assert (d.iso, d.precision, d.flag) == (iso, precision, flag)


def test_lists(spark):
    assert one(spark, values.split_list, "IS 1489 (Part 1, Part 2); IS 2") == ["IS 1489 (Part 1, Part 2)", "IS 2"]
    assert one(spark, values.split_list, "goods shall be red, green") == ["goods shall be red, green"]
    assert one(spark, values.split_list, "red, green, RED") == ["red", "green"]
    assert one(spark, values.split_list, None) == []


def test_standards(spark):
    found = one(spark, standards.parse_numbers, "IS 302-1, IS/IEC 62368-1:2018; IS 1489 (Part 1) : 2015")
    assert [(x.canonical, x.standard_id, x.year) for x in found] == [
        ("IS 302 (Part 1)", "STD-302-P1", ""),
        ("IS/IEC 62368-1", "STD-IEC-62368-1", "2018"),
        ("IS 1489 (Part 1)", "STD-1489-P1", "2015"),
    ]
    assert one(spark, standards.first_number, "IS 1, IS 2").status == "PARSED_FIRST_OF_2"
    assert one(spark, standards.split_number_and_date, "S.O. 294(E) (21-01-2020)").number == "S.O. 294(E)"
    scope = one(spark, standards.split_scope, "Applies to toys. No general exclusions. Excludes S.O. 12 items. Amended in 2020.")
    assert scope.scope == "Applies to toys. No general exclusions."
    assert scope.exclusions == "Excludes S.O. 12 items."
    assert scope.amendments == "Amended in 2020."
    who = one(spark, standards.split_name_and_address, "A Co. Ltd., | Address : 1 Moo | City : - | Country : Thailand")
    assert (who.name, who.address, who.city, who.country) == ("A Co. Ltd.", "1 Moo", "", "Thailand")


def test_urls(spark):
    assert one(spark, values.nurl, "see https://a.b/c.").asDict() == {"url": "https://a.b/c", "label": "see", "cls": "URL_IN_TEXT"}
    assert one(spark, values.nurl, "www.gov.in/x").cls == "URL_SCHEME_ADDED"
    assert one(spark, values.nlicence, "CML 12 34 567").licence_key == "1234567"


def test_model_check():
    from dataclasses import replace

    from lumenfold.plans.building import MODEL

    assert MODEL.check() == []
    wrong = replace(MODEL, prefixes={"PRODUCT": "X", "SUPPLIER": "X", "BRAND": "B"}, keys={"PRODUCT": [["p_name"]]}, edges={("SUPPLIER", "country"): ("IN_COUNTRY", "COUNTRY", None)})
    assert wrong.check() == ["entity COUNTRY has no prefix", "entity SUPPLIER has no key", "column p_brand of PRODUCT is an edge without a relation", "prefix X is used twice"]
