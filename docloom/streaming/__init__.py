"""The incremental flows as Structured Streaming queries."""
