"""Incremental views of a growing log."""
