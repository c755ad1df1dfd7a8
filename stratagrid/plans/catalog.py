"""All named queries: importing this module registers them."""

from __future__ import annotations

from stratagrid.plans import q_aggregate, q_apply, q_cells, q_census, q_geo, q_ml, q_raster, q_sampling, q_series  # noqa: F401
from stratagrid.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
