"""Column expressions for survey attributes."""
