"""Learned screening of very large candidate tables, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
