"""Column expressions and storage helpers that the operators share."""
