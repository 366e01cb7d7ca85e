"""Operators: DataFrame in, DataFrame out; none collects an unbounded set."""
