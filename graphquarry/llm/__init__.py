"""Operators that prepare training data for language models; nothing else in the library uses them."""
