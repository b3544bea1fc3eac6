"""Table layer: kind schemas, readers, adapters, registry and ingest."""
