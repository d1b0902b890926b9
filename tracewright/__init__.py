"""Span analytics and corpus preparation on Spark."""
