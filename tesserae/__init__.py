"""Versioned record, retrieval and analytics engine on PySpark DataFrames."""

__version__ = "0.1.0"
