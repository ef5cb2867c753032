"""Column functions; nothing here reads data."""
