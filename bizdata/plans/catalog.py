"""Imports every module that registers queries."""

from . import columns, flagship, jobs, joins, mentions, metrics, search, streams  # noqa: F401
