"""All queries of the engine's own operators."""

from __future__ import annotations

from . import analytic_queries, graph_queries, link_queries, parser_queries, procedure_queries, state_queries, text_queries  # noqa: F401  each registers its queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
