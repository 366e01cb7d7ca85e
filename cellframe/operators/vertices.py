"""Particles as tables for rendering: single-precision attributes, and the elements that aren't images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.operators.ranking import dense_number

SINGLE = {"double": "float", "bigint": "int"}


def vertex_buffer(df: DataFrame, attributes: dict[str, int], images: DataFrame | None = None) -> DataFrame:
    """vertex (0, 1, ...), is_ghost, and a column a<slot> for each field: doubles become floats, longs ints.

    Vertices are numbered by id, images after the particles; an unknown field
    raises. Longs beyond 32 bits wrap; nulls stay.
    """
    if unknown := sorted(set(attributes) - set(df.columns)):
        raise KeyError(f"unknown fields {unknown}")
    every = df.withColumn("is_ghost", F.lit(False))
    if images is not None:
        every = every.unionByName(images.select(*(c for c in images.columns if c in every.columns)), allowMissingColumns=True)
    kinds = dict(every.dtypes)
    every = every.select("id", "is_ghost", *(F.col(n).cast(SINGLE.get(kinds[n], kinds[n])).alias(f"a{slot}") for n, slot in attributes.items()))
    return dense_number(every, ["is_ghost", "id"], "vertex").drop("id")


def elements(buffer: DataFrame) -> DataFrame:
    """The vertices of the particles themselves."""
    return buffer.where(~F.col("is_ghost")).select("vertex")
