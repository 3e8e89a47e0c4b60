"""Layered (bronze -> silver -> gold -> serving) data processing on Spark DataFrames."""

from stratiform.session import configure, session

__all__ = ["configure", "session"]
