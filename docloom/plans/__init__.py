"""The four end-to-end flows: ingest, chunk, index and answer."""
