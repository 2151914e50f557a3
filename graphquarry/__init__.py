"""Code-base property graphs, built and queried as Spark DataFrames."""

from graphquarry.graph import CodeGraph

__all__ = ["CodeGraph"]
