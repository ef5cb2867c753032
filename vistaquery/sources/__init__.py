"""sources of the catalog engine."""
