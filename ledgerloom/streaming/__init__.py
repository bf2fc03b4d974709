"""Incremental ingestion of document folders."""
