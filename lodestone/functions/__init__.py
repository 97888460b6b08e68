"""Column expressions on vectors and texts."""
