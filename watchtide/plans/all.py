"""Importing this module registers every query."""

from . import alert_records, chain, detect, feed_stream, feeds, lifecycle, quotes, streams, tables
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "alert_records", "chain", "detect", "feed_stream", "feeds", "lifecycle", "quotes", "streams", "tables"]
