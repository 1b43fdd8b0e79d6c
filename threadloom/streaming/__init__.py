"""Incremental runs over a folder that grows."""
