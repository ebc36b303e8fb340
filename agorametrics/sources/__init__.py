"""Stored tables and file sources."""
