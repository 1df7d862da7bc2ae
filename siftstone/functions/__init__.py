"""Column and grouped functions."""
