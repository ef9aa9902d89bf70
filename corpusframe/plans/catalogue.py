"""Named queries over the sample tables, with equivalent SQL."""

from __future__ import annotations

from . import array_queries, build_queries, file_queries, segment_queries, select_queries, text_queries
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "array_queries", "build_queries", "file_queries", "segment_queries", "select_queries", "text_queries"]
