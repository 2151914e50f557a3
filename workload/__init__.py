"""Queries over the benchmark tables, each with an independent SQL statement of its result."""
