"""Incremental and streaming upkeep."""
