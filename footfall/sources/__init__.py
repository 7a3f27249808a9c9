"""Readers: scan files, dimensions, tables, streams."""
