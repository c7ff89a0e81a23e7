"""Registered queries over tables."""
