"""gameline: leak-safe entity time-series analytics on PySpark."""

__version__ = "0.1.0"
