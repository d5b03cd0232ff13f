"""Groups, versions, coverage and steps against plain versions."""

import random
from collections import defaultdict

from lumenfold.operators import grouping

PAIRS = "file_a string, file_b string, decision string, unique_a long, unique_b long, lost_a long, lost_b long, conflicts long, common_keys long, archived long, key_column string, identity string"


def pairs(spark, *rows):
    full = [(a, b, d, *more, *(0, 0, 0, 0, 0, 5, 0)[len(more) :], "k", "KEY_LINKED") for a, b, d, *more in rows]
    return spark.createDataFrame(full, PAIRS)


def test_components(spark):
    draw = random.Random(2)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2030)] + [(5, 5), (None, 3)]
    under = {}
    find = lambda x: x if under.setdefault(x, x) == x else find(under[x])
    for a, b in links:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            under[y] = x
    found = grouping.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {n: find(n) for n in under} and len(found) == len(under)
    assert grouping.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_version_chains(spark):
    newer = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "c"), ("x", "y"), ("y", "z"), ("z", "y"), ("z", "w"), ("w", "v"), ("z2", "z1")]
    rows = [(o, n, "VERSION_NEWER") if i % 2 else (n, o, "VERSION_OLDER") for i, (o, n) in enumerate(newer)] + [("a", "q", "COMPLEMENTARY")]
    found = {r.file_id: (r.chain_id, r.position, r.latest, r.status) for r in grouping.version_chains(pairs(spark, *rows)).collect()}
    assert found == {
        "a": ("a", 0, False, "ORDERED"), "b": ("a", 1, False, "ORDERED"), "c": ("a", 2, True, "ORDERED"), "d": ("a", 0, False, "ORDERED"), "x": ("v", 0, False, "ORDERED"), "y": ("v", None, False, "CYCLE"),
        "z": ("v", None, False, "CYCLE"), "w": ("v", None, False, "AFTER_CYCLE"), "v": ("v", None, False, "AFTER_CYCLE"), "z2": ("z1", 0, False, "ORDERED"), "z1": ("z1", 1, True, "ORDERED"),
    }
    assert grouping.version_chains(pairs(spark)).count() == 0


def test_groups_and_fates(spark):
    made = pairs(
        spark,
        ("A", "B", "IDENTICAL_CONTENT", 0, 0, 0, 0, 0, 10, 10), ("A", "C", "COMPLEMENTARY", 3, 4), ("B", "C", "COMPLEMENTARY", 3, 4),  # B is a copy that adds to C as A does
        ("D", "E", "VERSION_NEWER", 0, 0, 0, 0, 6), ("F", "G", "VERSION_NEWER", 0, 0, 2, 0, 1),  # F has columns that G lacks
        ("D", "C", "COMPLEMENTARY", 5, 9), ("H", "I", "DIFFERENT_ENTITY", 0, 0), ("J", "K", "REQUIRES_REVIEW"),
    )
    files = spark.createDataFrame([(f, i, None if f == "L" else "t") for i, f in enumerate("ABCDEFGHIJKL")], "file_id string, n_rows long, target string")
    kept = grouping.canonical_files(files, made)
    status = {r.file_id: (r.status.split("_")[1] if r.status.startswith("KEEP") else "GONE", r.covered_by, r.unique_to, r.residual) for r in kept.collect()}
    assert status == {
        "A": ("AND", "", "C", "C"), "B": ("GONE", "A", "C", ""), "C": ("AND", "", "A; B; D", "A; B; D"), "D": ("CONTAINS", "E", "C", "C"), "E": ("PENDING", "", "", ""), "F": ("PENDING", "", "", ""), "G": ("PENDING", "", "", ""),
        "H": ("DISTINCT", "", "", ""), "I": ("DISTINCT", "", "", ""), "J": ("PENDING", "", "", ""), "K": ("PENDING", "", "", ""), "L": ("AS", "", "", ""),
    }
    groups = {r.file_id: (r.group_id, r.n_files, r.canonical) for r in grouping.dataset_groups(files, made).collect()}
    assert groups["B"] == ("A", 2, "B") and groups["D"] == groups["E"] == ("D", 2, "E") and groups["L"] == ("L", 1, "L") and len(groups) == 12
    steps = {r.target: r for r in grouping.merge_steps(files, made, kept).collect()}
    t = steps["t"]
    assert (t.n_files, t.rows_in, t.least_out, t.collapsed, t.splits, t.approval) == (10, 54, 44, 10, 1, True)
    assert t.decisions == "COMPLEMENTARY=2; DIFFERENT_ENTITY=1; REQUIRES_REVIEW=1; VERSION_NEWER=2"
    assert (steps["unclassified"].key_status, steps["unclassified"].approval) == ("NO_SHARED_KEY", False)


def test_cover_sets(spark):
    draw = random.Random(8)
    keys = [(f"f{draw.randrange(9)}", draw.randrange(60)) for _ in range(240)] + [("lone", 1000), ("part", 3), ("part", 1001), ("none", None)]
    held = defaultdict(set)
    for f, k in keys:
        if k is not None:
            held[f].add(k)
    expected = {}
    for f in held:
        left, chosen = set(held[f]), []
        while best := min(((-len(left & held[o]), o) for o in held if o != f and left & held[o]), default=None):
            chosen.append(best[1])
            left -= held[best[1]]
        expected[f] = (len(held[f]), "; ".join(chosen), len(left))
    found = grouping.cover_sets(spark.createDataFrame(keys, "file_id string, key long")).collect()
    assert {r.file_id: (r.n_keys, r.covered_by, r.residual) for r in found} == expected
    assert grouping.cover_sets(spark.createDataFrame([], "file_id string, key long")).count() == 0
