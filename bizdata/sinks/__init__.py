"""Exports and logs."""
