"""Queries of the library's own operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fact_queries, join_queries, review_queries, story_queries, text_queries

PARTS = (text_queries, story_queries, join_queries, review_queries, fact_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for p in PARTS for k, v in p.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for p in PARTS for k, v in p.ORACLES.items()}
