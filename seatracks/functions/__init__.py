"""Column functions: no shuffle, all inside generated code (but for the vectorized DTW helper)."""
