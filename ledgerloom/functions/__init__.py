"""Column expressions: cleaning, rounding and deterministic draws."""
