"""Sensitive-text detection and redaction as Spark DataFrame operations."""

__version__ = "0.1.0"
