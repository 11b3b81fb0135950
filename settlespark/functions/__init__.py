"""Column expressions and skew-safe keyed / ordered building blocks."""
