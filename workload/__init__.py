"""Queries of the driver contract: library operators bound to the given tables."""

from workload import document_queries, finance_queries, registry_queries, response_queries, similarity_queries, text_queries

MODULES = [registry_queries, finance_queries, text_queries, document_queries, similarity_queries, response_queries]
