"""Measurement curation and benchmark analytics as Spark DataFrame operators."""

from tidegauge.registry import all_queries, oracle_statements
from tidegauge.session import build_session

__all__ = ["all_queries", "oracle_statements", "build_session"]
