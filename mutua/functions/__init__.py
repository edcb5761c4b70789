"""Column expressions and aggregate formulas."""
