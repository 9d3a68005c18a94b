"""All queries over the session model, by name."""

from __future__ import annotations

from .plans import answer_queries, attribution_queries, cut_queries, forest_queries, frozen_queries, ledger_queries, persistence_queries, prefix_queries, probe_queries, record_queries, scoring_queries, snap_queries, text_queries, transcript_queries, tree_queries  # noqa: F401
from .plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "projection_summary"
