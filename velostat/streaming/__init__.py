"""Incremental ingestion of trip files (Structured Streaming)."""

from velostat.streaming.ingest import append_trips, trip_stream  # noqa: F401
