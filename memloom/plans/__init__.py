"""Views over the test tables, query plans and the catalogue of queries."""

from memloom.plans import memory_queries, more_queries, report_queries, search_queries, store_log_queries, store_queries, summary_queries, vector_queries, write_queries  # noqa: F401
from memloom.plans.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
