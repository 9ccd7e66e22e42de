"""Registered queries. Importing this package fills the registry."""

from stockspark.plans import (compare_queries, expiry_sample_queries, ingest_queries,  # noqa: F401
                              restock_queries,
                              history_queries, report_queries, state_queries, streaming_queries,
                              velocity_queries)
from stockspark.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
