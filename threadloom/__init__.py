"""Threaded-archive analytics expressed as Spark DataFrame, SQL and streaming jobs."""
