"""Column expressions and column policies."""
