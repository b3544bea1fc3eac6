"""Structured Streaming: ingest, running posteriors, windowed rates."""
