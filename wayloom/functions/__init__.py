"""Column expressions and rules tables."""
