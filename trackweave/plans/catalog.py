"""All queries of the library by name, with their SQL where SQL can express them."""

from __future__ import annotations

from . import cluster_queries, clustering_queries, procedure_queries, report_queries, selection_queries, source_queries, track_queries, vector_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
