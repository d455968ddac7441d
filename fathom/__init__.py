"""Ranked retrieval, typed filters, facets and similarity over Spark DataFrames."""

__version__ = "0.1.0"
