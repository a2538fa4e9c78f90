"""Dependency analytics over workflow definitions and their history, on Spark."""
