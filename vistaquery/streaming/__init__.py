"""streaming of the catalog engine."""
