"""operators of the catalog engine."""
