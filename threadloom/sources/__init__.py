"""Readers of conversation exports, their registry, and sinks for files that need names."""
