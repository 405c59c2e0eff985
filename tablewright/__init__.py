"""Tabular profiling, cleaning, drift, evaluation and operations analytics on Apache Spark.

Every public function takes DataFrames and returns DataFrames (or, for fitted
objects, a small frame of fitted values), and leaves the execution to Catalyst,
AQE and Structured Streaming.
"""

from tablewright.session import build_session

__all__ = ["build_session"]
