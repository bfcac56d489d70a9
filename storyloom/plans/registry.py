"""All registered queries of the graph engine."""

from __future__ import annotations

from storyloom.plans import queries_checks, queries_folds, queries_lifecycle, queries_loading, queries_notes, queries_policies, queries_report, queries_stores, queries_tables, queries_views

PARTS = (queries_checks, queries_folds, queries_lifecycle, queries_loading, queries_notes, queries_policies, queries_report, queries_stores, queries_tables, queries_views)
QUERIES = {k: v for p in PARTS for k, v in p.QUERIES.items()}
ORACLES = {k: v for p in PARTS for k, v in p.ORACLES.items()}
