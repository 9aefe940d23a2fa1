"""Column expressions and predicate builders (built-in Spark functions only)."""
