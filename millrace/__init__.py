"""Millrace: a Spark-native optimizer and runner for pipelines of SQL models."""

__version__ = "0.1.0"
