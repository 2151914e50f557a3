"""Column functions for paths and source text (native expressions only)."""
