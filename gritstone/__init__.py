"""Incident analytics over request-level wide events, as Spark DataFrame and Structured Streaming functions."""
