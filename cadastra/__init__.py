"""Regulatory and property analytics as Spark DataFrame, SQL and Structured Streaming plans."""
