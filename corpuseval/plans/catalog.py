"""All registered queries and their SQL twins."""

from __future__ import annotations

from corpuseval.plans import q_evaluation, q_records, q_selection, q_text  # noqa: F401  they register
from corpuseval.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
