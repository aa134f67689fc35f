"""Column expressions (calendar, scalars, metrics)."""
