"""Desired-state analytics on Spark: conditions, drift, lineage, history, export and streams."""
