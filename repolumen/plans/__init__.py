"""Runnable queries over the given tables and the SQL that checks them."""

from . import (document_oracle, document_queries, file_oracle, file_queries, request_oracle, request_queries,
               rollup_oracle, rollup_queries, source_oracle, source_queries, stream_oracle, stream_queries)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
