"""Readers and writers: source trees, commit-log dumps, blame dumps and the graph tables."""
