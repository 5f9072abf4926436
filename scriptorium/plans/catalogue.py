"""All queries on the driver's tables, with oracle SQL."""

from __future__ import annotations

from scriptorium.plans import corpora, documents, events_plans, profile_plans, source_plans, style_plans

FLAGSHIP = "document_features"
MODULES = (documents, corpora, events_plans, profile_plans, style_plans, source_plans)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
