"""All registered queries."""

from ledgerlens.plans import (  # noqa: F401
    metric_queries, report_queries, search_queries, tagging_queries, vector_queries)
from ledgerlens.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
