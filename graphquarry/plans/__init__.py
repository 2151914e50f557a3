"""Compositions of operators: the index build, the graph report and batched requests."""
