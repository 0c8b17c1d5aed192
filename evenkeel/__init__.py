"""Skew-aware batch analytics on Spark: statistics, cost, plans and placement as DataFrame operations."""
