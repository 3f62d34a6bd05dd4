"""All registered queries and their SQL twins."""

from __future__ import annotations

from tamarack.plans import extracts, fields, records, reports, sites  # noqa: F401  (they register their queries)
from tamarack.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
