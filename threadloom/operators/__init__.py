"""Relational operators on messages, pairs, files and snapshots."""
