"""Column expressions and row-wise table jobs."""
