"""Registered queries: every operator on tables derived from the benchmark data."""
