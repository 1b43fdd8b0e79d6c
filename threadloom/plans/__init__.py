"""Workflows, the folder layout, and the query catalogue."""
