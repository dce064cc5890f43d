"""Schemas, readers, writers and the table catalogue."""
