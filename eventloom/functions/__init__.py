"""Column functions on arrays and tokens."""
