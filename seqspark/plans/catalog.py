"""All registered queries with the SQL that DuckDB runs for comparison."""

from __future__ import annotations

from seqspark.plans import q_clean, q_grid, q_model, q_more, q_service, q_signals, q_stats, q_stream, q_surface, q_windows  # noqa: F401
from seqspark.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
