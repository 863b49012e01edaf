"""Tessera plans."""

from . import model_queries, queries, rule_queries

__all__ = ["model_queries", "queries", "rule_queries"]
