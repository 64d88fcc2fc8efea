"""All queries over the standard tables and their SQL."""

from __future__ import annotations

from . import audits, curation, evaluation, linkage, manifests, trips


def queries() -> dict:
    return curation.Q | evaluation.Q | audits.Q | linkage.Q | manifests.Q | trips.Q


def oracle_sql() -> dict[str, str]:
    return curation.SQL | evaluation.SQL | audits.SQL | linkage.SQL | manifests.SQL | trips.SQL
