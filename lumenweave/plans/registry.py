"""All queries of the library proper, and the SQL that each must equal."""

from __future__ import annotations

from lumenweave.plans import jobs_queries, library_queries, search_queries
from lumenweave.plans.base import QUERIES, SQL

FLAGSHIP = search_queries.unified_search
GROUPS = (search_queries, library_queries, jobs_queries)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
