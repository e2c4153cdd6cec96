"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from . import geometry_queries, model_queries, report_queries, track_queries

MODULES = (track_queries, geometry_queries, model_queries, report_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: q for m in MODULES for k, q in m.ORACLE.items()}
