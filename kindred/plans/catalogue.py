"""All queries of the library, with their SQL."""

from . import file_queries, model_queries, relation_queries, sketch_queries, stream_queries, vector_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
