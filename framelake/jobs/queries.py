"""All queries of the media operators by name, and the SQL that checks them."""

from __future__ import annotations

from . import byte_queries, log_queries, project_queries, raster_queries

_PARTS = (raster_queries, log_queries, project_queries, byte_queries)
QUERIES = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLE_SQL = {k: s for part in _PARTS for k, s in part.ORACLE_SQL.items()}
