"""Column functions on single rows."""
