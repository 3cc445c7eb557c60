"""Column expressions and special functions."""
