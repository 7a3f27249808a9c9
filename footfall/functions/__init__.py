"""Column functions: time, strings."""
