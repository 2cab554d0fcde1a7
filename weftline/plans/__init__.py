"""Registered queries."""

from weftline.plans import aggregate_queries, audit_queries, candidate_queries, feature_queries, matching_queries, relational_queries, retrieval_queries, text_queries  # noqa: F401
from weftline.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
