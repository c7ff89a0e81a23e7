"""Operators on logs as DataFrames: pure plans, no files."""
