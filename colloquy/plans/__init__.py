"""Fixtures over the given tables and the registered queries."""

from . import analytics, streams, transcripts
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analytics", "streams", "transcripts"]
