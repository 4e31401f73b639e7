"""All queries over the driver's tables and their SQL."""

from __future__ import annotations

from reweave.plans import graph_queries, paper_queries, report_queries, source_queries, stats_queries, text_queries

MODULES = [graph_queries, report_queries, stats_queries, text_queries, paper_queries, source_queries]
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
