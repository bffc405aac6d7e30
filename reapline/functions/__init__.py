"""Column functions, grouped by what they read."""
