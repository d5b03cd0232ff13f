"""Rechecks equal first checks, at the cost of what changed."""

import pytest

from lumenfold.operators import recheck

DOCS = [
    (1, "CALIBRATION_CERTIFICATE", "Certificate No: CC-99\nvalid until: 2027-01-05\ninstrument id: GAUGE-7"), (2, "TEST_REPORT", "test name: strength\nresult: pass\ntest date: 2025-02-03"),
    (3, "FACTORY_DOCUMENT", "factory name: Northern Works\naddress: 5 Mill Lane"), (4, "TEST_REPORT", ""), (5, None, None),
]
ASKED = [("R1", "calibration of the gauge", "CALIBRATION", "calibration certificate"), ("R2", "strength test of samples", "TESTING", "test report"), ("R3", "premises of the factory", "FACTORY", "layout"), ("R4", "manual of quality", "MANUAL", "manual")]
SCHEMA = ("doc_id long, category string, text string", "requirement_id string, requirement string, type string, evidence_expected string")


@pytest.fixture
def tables(spark):
    return lambda docs, asked: (spark.createDataFrame(docs, SCHEMA[0]), spark.createDataFrame(asked, SCHEMA[1]))


def same(a, b):
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(a.decisions) == rows(b.decisions)
    assert rows(a.evidence) == rows(b.evidence)
    assert rows(a.candidates) == rows(b.candidates)


def test_recheck_equals_check(tables):
    today = "2026-01-01"
    first = recheck.check(*tables(DOCS[:-1], ASKED), today)
    assert tuple(first.work.first())[:3] == (4, 4, 0)
    assert {r.requirement_id: r.decision for r in first.decisions.collect()}["R2"] == "PASS"

    more = [*DOCS, (6, "TEST_REPORT", "result: fail")]
    second = recheck.recheck(first, *tables([*DOCS[:-1], more[-1]], ASKED))
    assert tuple(second.work.first())[:3] == (5, 1, 4)  # one new document, one extracted
    assert second.work.first()["n_decided"] < len(ASKED)
    same(second, recheck.check(*tables([*DOCS[:-1], more[-1]], ASKED), today))

    changed = [(1, DOCS[0][1], DOCS[0][2].replace("2027", "2025")), *DOCS[2:]]  # one changed, two gone, one came
    asked = [ASKED[0], (*ASKED[1][:3], "report of the laboratory"), ASKED[2]]
    third = recheck.recheck(second, *tables(changed, asked))
    assert third.work.first()["n_extracted"] == 2
    same(third, recheck.check(*tables(changed, asked), today))
    assert {r.requirement_id: r.reason_code for r in third.decisions.collect()}["R1"] == "EXPIRED"

    later = recheck.recheck(first, *tables(DOCS[:-1], ASKED), "2030-01-01")
    assert later.work.first()["n_extracted"] == 0
    same(later, recheck.check(*tables(DOCS[:-1], ASKED), "2030-01-01"))
    nothing = recheck.recheck(first, *tables([], []))
    assert nothing.decisions.count() == nothing.evidence.count() == 0
