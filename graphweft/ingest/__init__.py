"""Declarative ingest: sources, filters, lookups, transforms, writers."""
