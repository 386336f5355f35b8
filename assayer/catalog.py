"""Every registered query of the library and the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayer.plans import agreement_queries, card_queries, coverage_queries, frame_queries, reliability_queries, resample_queries, source_queries, stat_queries, stream_queries

_PARTS = (agreement_queries, stat_queries, reliability_queries, frame_queries, stream_queries, resample_queries, source_queries, card_queries, coverage_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for part in _PARTS for name, f in part.Q.items()}
ORACLES: dict[str, str] = {name: text for part in _PARTS for name, text in part.SQL.items()}
