"""Structured Streaming: incremental ingestion, windowed counts and the memory of conversations."""
