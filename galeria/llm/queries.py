"""The operators' queries and the SQL that DuckDB can run for them."""

from __future__ import annotations

import importlib

MODULES = {
    "op1_near_duplicates": "dedup",
    "op2_license_scan": "licenses",
    "op3_url_filter": "urls",
    "op4_decontaminate": "decontam",
    "op5_quality": "quality",
    "op6_shard": "shard",
    "op7_neighbours": "ann",
    "op8_language": "langid",
    "op9_mix": "mix",
    "op10_pii": "pii",
    "op11_filter_audit": "audit",
    "op12_pieces": "pieces",
    "op13_collocations": "phrases",
}


def queries() -> dict:
    """Query functions by name."""
    return {name: getattr(importlib.import_module(f"galeria.llm.{m}"), name) for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL by query name, where SQL can express the query."""
    modules = {name: importlib.import_module(f"galeria.llm.{m}") for name, m in MODULES.items()}
    return {name: m.ORACLE_SQL for name, m in modules.items() if getattr(m, "ORACLE_SQL", None)}
