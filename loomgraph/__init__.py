"""Spark-first text-to-graph analytics: DataFrame operators, no RDD code."""

__version__ = "0.1.0"
