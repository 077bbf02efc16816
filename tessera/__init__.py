"""tessera: analytics over context records, written with PySpark DataFrames, SQL and Structured Streaming."""

__version__ = "0.1.0"
