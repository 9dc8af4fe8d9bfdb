"""All registered log queries and their SQL."""

from __future__ import annotations

from . import catalog, files

QUERIES = catalog.QUERIES | files.QUERIES
ORACLE_SQL = catalog.ORACLE_SQL | files.ORACLE_SQL
flagship = catalog.flagship
