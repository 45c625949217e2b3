"""Readers, extractors and sinks for registry and enrichment data."""
