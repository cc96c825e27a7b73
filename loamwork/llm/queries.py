"""The queries opN_<name> of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Query name to the module that holds its function ``query`` and, where SQL can express it, ``SQL``.
MODULES = {
    "op4_secret_scan": "q4_secret_scan",
    "op9_pieces": "q9_pieces",
    "op3_html_text": "q3_html_text",
    "op6_quality_rules": "q6_quality_rules",
    "op7_quality": "q7_quality",
    "op2_jaccard": "q2_jaccard",
    "op5_line_dedup": "q5_line_dedup",
    "op10_packing": "q10_packing",
    "op8_token_files": "q8_token_files",
    "op1_fingerprints": "q1_fingerprints",
}


def queries() -> dict:
    return {name: import_module(f"loamwork.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"loamwork.llm.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
