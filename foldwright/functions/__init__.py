"""Column expressions: row-level functions, hash-derived random numbers and metric aggregates."""
