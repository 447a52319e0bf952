"""Readers and payload mappings."""
