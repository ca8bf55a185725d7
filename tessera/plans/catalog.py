"""All queries by name, with the SQL that states what each returns."""

from __future__ import annotations

from tessera.plans import analytics, judging, procedures, retrieval, texts  # noqa: F401  each module enters its queries
from tessera.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
