"""Behaviour analytics on Spark: tracks to features, states, bins, segments, summaries and query tools."""
