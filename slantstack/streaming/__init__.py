"""Incremental ingestion of new pairs."""
