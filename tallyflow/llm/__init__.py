"""Operators for training data; nothing else in the library imports this package."""

from tallyflow.llm import association_queries, document_queries, leakage_queries, packing_queries, term_queries

MODULES = [association_queries, document_queries, leakage_queries, packing_queries, term_queries]
