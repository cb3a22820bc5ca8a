"""Canonical input tables, their loaders, and result sinks."""
