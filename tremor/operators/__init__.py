"""Column-level and table-level operators."""
