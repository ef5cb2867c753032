"""plans of the catalog engine."""
