"""Cuts and outputs against plain string versions."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.llm.fill_in_middle import Recipe, cut, fill_in_middle, restored, select, unit_ends

from .conftest import ODD


def plain_units(text, unit):
    if unit == "char":
        return list(text)
    if unit == "line":
        return text.splitlines(keepends=True) if not re.search("[\v\f\r\x1c-\x1e\x85  ]", text) else re.findall(r"[^\n]*\n|[^\n]+", text)
    found = re.findall(r"[^\t-\r ]+[\t-\r ]*", text)
    lead = re.match(r"[\t-\r ]*", text)[0]
    return [lead + found[0], *found[1:]] if found else [text] * bool(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\tÿ漢😀", max_size=90), st.sampled_from(["char", "word", "line"]))
def test_units(text, unit):
    data, units = text.encode(), plain_units(text, unit)
    ends = unit_ends(data, unit)
    assert ends.bit_count() == len(units)
    assert [data[: cut(ends, k)].decode() for k in range(len(units) + 1)] == ["".join(units[:k]) for k in range(len(units) + 1)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 1 << 700))
def test_select(mask):
    places = [i for i in range(mask.bit_length()) if mask >> i & 1]
    assert [select(mask, k) for k in range(len(places))] == places


def plain(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_outputs(spark, docs):
    rows = [*ODD, (20, "with <S> inside"), (21, "a" * 999 + "<"), *((i, "Çedilla < é 漢字 > 😀 " * (i % 7)) for i in range(100, 160))]
    rows = [r if len(r) == 3 else (*r, "s") for r in rows]
    found = fill_in_middle(docs(rows).withColumnRenamed("lang", "form")).withColumn("text", restored()).collect()
    assert len(found) == len(rows)
    got = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_units, r.middle_units, r.output) for r in found), key=str)
    assert got == sorted(((r[0], r[1] or "", *plain(r[0], r[1])) for r in rows), key=str)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs(rows).limit(0)).count() == 0


def test_recipes(spark, docs):
    recipe = Recipe(unit="word", changed=100, suffix_first=50, prefix="⟨pre⟩", suffix="⟨suf⟩", middle="⟨mid⟩")
    rows = [(i, f"  some words {i} of a text \n here ") for i in range(40)]
    found = fill_in_middle(docs(rows), recipe=recipe).withColumn("text", restored(recipe)).collect()
    assert {(r.doc_id, r.text) for r in found} == set(rows)
    assert {r.form for r in found} == {"psm", "spm"} and {r.n for r in found} == {7}
    with pytest.raises(ValueError, match="sentinels"):
        Recipe(prefix="<P<", suffix="<S>")
