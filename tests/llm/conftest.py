from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source) rows."""

    def make(rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


#: Rows that every operator must stand: nulls, empty and long texts, repeated rows, ties.
ODD = [
    (None, None, None),
    (None, "null id here", None),
    (1, None, "a"),
    (2, "", "a"),
    (3, " \n\t ", "b"),
    (4, "same text in two rows " * 5, "b"),
    (4, "same text in two rows " * 5, "b"),
    (5, "same text in two rows " * 5, "b"),
    (6, "w " * 30_000, "c"),
    (7, "x" * 50_000, "c"),
    (8, "ünï çødé — 漢字 пример", "d"),
]
