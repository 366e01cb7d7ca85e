"""Particle and grid analytics on Spark DataFrames."""

from cellframe.domain import Domain

__all__ = ["Domain"]
