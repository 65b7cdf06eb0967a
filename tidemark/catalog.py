"""All queries by name, and their DuckDB twins."""

from __future__ import annotations

from .plans import cohorts, market, quoting, rules, scans, studies, sweeps  # noqa: F401  (the others add to the queries of market)


def queries() -> dict:
    return dict(market.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(market.ORACLE)
