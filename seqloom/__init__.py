"""seqloom: event-log analytics on PySpark DataFrames, SQL and Structured Streaming."""

__all__ = ["functions", "sources", "operators", "plans", "streaming"]
