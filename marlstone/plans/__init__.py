"""Composed plans: search, ingest, enrichment, and the query catalogue."""
