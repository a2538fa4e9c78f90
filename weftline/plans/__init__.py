"""Schemas, lineage and composite plans."""
