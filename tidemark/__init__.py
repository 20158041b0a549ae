"""Tidemark: event histories, hybrid retrieval and document assembly on Spark."""
