"""Queries of the engine and their SQL equivalents, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import answer_queries, chunk_queries, composed_queries, graph_queries, reference_queries, search_queries, source_queries, state_queries

_PARTS = (answer_queries, composed_queries, graph_queries, chunk_queries, search_queries, state_queries, reference_queries, source_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for p in _PARTS for k, v in p.ORACLES.items()}
