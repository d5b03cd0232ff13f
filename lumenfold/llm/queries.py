"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: query name: (module of this subpackage, name of its SQL there)
QUERIES = {
    "op1_license_scan": ("license_scan", None),
    "op8_pii": ("pii", None),
    "op4_language_id": ("language_id", None),
    "op6_quality_classifier": ("quality_classifier", None),
    "op9_line_dedup": ("line_dedup", "SQL"),
    "op3_sharding": ("sharding", None),
    "op7_mixing": ("mixing", None),
    "op5_decontaminate": ("decontaminate", None),
    "op2_jaccard_join": ("jaccard_join", "SQL"),
    "op10_quality_rules": ("quality_rules", "SQL"),
    "op11_spelling_variants": ("spelling", "SQL"),
    "op12_fill_in_middle": ("fill_in_middle", "SQL"),
    "op13_warc": ("warc", "SQL"),
}


def queries() -> dict:
    return {name: getattr(import_module(f"lumenfold.llm.{module}"), name) for name, (module, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"lumenfold.llm.{module}"), sql) for name, (module, sql) in QUERIES.items() if sql}
