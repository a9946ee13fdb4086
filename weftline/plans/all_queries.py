"""Loads every query module; the registry then holds all queries."""

from weftline.plans import (  # noqa: F401
    catalog_queries,
    graph_queries,
    lineage_queries,
    report_queries,
    store_queries,
    trace_queries,
)
from weftline.plans.registry import CHECKS, QUERIES  # noqa: F401
