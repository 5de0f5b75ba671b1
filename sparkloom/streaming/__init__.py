"""Incremental runs of the check tables."""
