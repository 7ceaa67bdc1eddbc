"""All named queries; importing the modules registers them."""

from __future__ import annotations

from tessera.plans import ai_queries, core_queries, search_queries, series_queries  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES  # noqa: F401
