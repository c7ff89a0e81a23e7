"""Scalar functions as Column expressions, and the checksum."""
