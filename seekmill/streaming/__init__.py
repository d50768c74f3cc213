"""Structured Streaming: ingest, sessions, stateful politeness, event logs."""
