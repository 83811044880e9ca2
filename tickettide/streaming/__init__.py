"""Structured Streaming forms of the sync job, the ingest log and the trends."""
