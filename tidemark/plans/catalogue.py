"""All registered queries and their SQL."""

from . import library_queries, pack_queries, search_queries, stream_queries, text_queries  # noqa: F401  they register themselves
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
