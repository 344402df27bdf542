"""Registered queries and their oracles."""

from corpusloom.plans import clean_queries, file_queries, pool_queries, rule_queries, score_queries, text_queries
from corpusloom.plans.catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "clean_queries", "file_queries", "pool_queries", "rule_queries", "score_queries", "text_queries"]
