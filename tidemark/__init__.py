"""Tidemark: a point-in-time panel engine on PySpark."""

__version__ = "0.1.0"
