"""All queries of the library's own operators."""

from __future__ import annotations

from . import queries_grid, queries_matrix, queries_more, queries_products, queries_regridder, queries_topo  # noqa: F401
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
