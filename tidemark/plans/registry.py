"""Registry of the warehouse queries and their SQL counterparts."""

from __future__ import annotations

from tidemark.plans import checks, queries, stored, warehouse, warehouse_sql  # noqa: F401  stored adds to queries' registry

QUERIES = queries.QUERIES | warehouse.QUERIES | checks.QUERIES
ORACLE = queries.ORACLE | warehouse_sql.ORACLE | checks.ORACLE
