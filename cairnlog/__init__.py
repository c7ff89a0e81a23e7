"""Recoverable append-only record logs as Spark plans."""
