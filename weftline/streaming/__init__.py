"""Incremental versions."""
