"""Every query of the library's own operators, with the SQL that gives the same rows."""

from __future__ import annotations

from archloom.jobs import audit, catalog, crawl, curated, extraction, graph, nodes, published, reports, rewriting, search, texts, tree, urls

QUERIES: dict = {}
ORACLE_SQL: dict = {}

for _module in (audit, urls, texts, catalog, tree, graph, extraction, search, rewriting, crawl, curated, published, reports, nodes):
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
