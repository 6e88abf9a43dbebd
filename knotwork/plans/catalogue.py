"""All registered queries of the core and their SQL."""

from __future__ import annotations

from knotwork.plans import ask_queries, graph_queries, insight_queries, report_queries, source_queries, text_queries  # noqa: F401
from knotwork.plans.registry import QUERIES, SQL  # noqa: F401
