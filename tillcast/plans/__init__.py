"""Composed jobs (feature table, per-store regression, blends, models) and the registered queries."""
