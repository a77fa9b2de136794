"""Scheduled, incremental runs of the ingest."""
