"""The queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from . import bpe, html_text, mixing, near_dup, neighbours, pii, preference, quality_model, quality_rules, warc

_MODULES = (bpe, html_text, mixing, near_dup, neighbours, pii, preference, quality_model, quality_rules, warc)


def queries() -> dict:
    """Every function opN_<name> of the modules."""
    return {name: f for m in _MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict:
    """ORACLE_SQL of the modules that have one, by query name."""
    return {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
