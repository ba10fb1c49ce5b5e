"""Registered queries of the analytics operators and their SQL counterparts."""

from . import report_queries, source_queries, stat_queries, store_queries, stream_queries, window_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
from .window_queries import temporal_features as flagship  # noqa: F401
