"""Append-only event-log analytics on Spark: log algebra as DataFrame plans."""

__version__ = "0.1.0"
