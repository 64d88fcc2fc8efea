"""All queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: Modules in the order of their operators.
MODULES = ("simhash", "tokens", "ngram_join", "bpe", "mixing", "quality", "pii", "exact_dedup", "line_dedup", "repeats", "importance", "filter_audit", "quality_rules")


def _modules():
    return [importlib.import_module(f"{__package__}.{m}") for m in MODULES]


def queries() -> dict:
    out = {}
    for m in _modules():
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for m in _modules():
        out |= m.ORACLE
    return out
