"""Deterministic choice of particles by keyed numbers: set a type, remove, thin out close pairs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.domain import Domain
from cellframe.functions.keys import uniform_key
from cellframe.functions.vec import matvec, vec
from cellframe.operators.neighbors import neighbors
from cellframe.operators.regions import Regions

BUCKETS = 1 << 14


def fields(names: list[str], patterns: list[str]) -> list[str]:
    """Names that one of the patterns matches in full."""
    return [n for n in names if any(re.fullmatch(p, n) for p in patterns)]


def eligible(domain: Domain, regions: Regions | None, region: str | None) -> Column:
    """Region test in lab space."""
    return (regions or Regions()).predicate(region, matvec(domain.xform, vec("r")), F.col("id"))


def chosen(df: DataFrame, among: Column, fraction: float | None, count: int | None, seed: int) -> Column:
    """Condition of the chosen rows among the eligible ones: all, each with a probability, or an exact number.

    The fraction f of N eligible rows is rounded to a threshold round(f N) / N.
    The exact number takes the smallest keys (ties by id), found by a histogram
    of the keys and an exact cut inside one bucket: nothing is sorted as a whole.
    Rows with a null id are never chosen by key.
    """
    if fraction is not None and count is not None:
        raise ValueError("give a fraction or a count, not both")
    if fraction is None and count is None:
        return among
    key = uniform_key(F.col("id"), seed)
    keyed = df.where(among & F.col("id").isNotNull()).select(F.col("id"), key.alias("key"))
    if fraction is not None:
        if not 0.0 <= fraction <= 1.0:
            raise ValueError("the fraction must lie in [0, 1]")
        n = keyed.count()
        return among & (key < F.lit(round(fraction * n) / n if n else 0.0))
    if count <= 0:
        return F.lit(False)
    left, cut = count, None
    for bucket, n in keyed.groupBy(F.floor(F.col("key") * BUCKETS).alias("b")).count().orderBy("b").collect():  # BUCKETS rows at most
        if n >= left:
            cut = keyed.where(F.floor(F.col("key") * BUCKETS) == bucket).orderBy("key", "id").limit(left).agg(F.max(F.struct("key", "id")).alias("m")).first().m
            break
        left -= n
    if cut is None:
        return among & F.col("id").isNotNull()
    return among & ((key < cut.key) | ((key == cut.key) & (F.col("id") <= cut.id)))


def set_particle_type(df: DataFrame, domain: Domain, type_: int, regions=None, region=None, fraction=None, count=None, seed: int = 0) -> DataFrame:
    pick = chosen(df, eligible(domain, regions, region), fraction, count, seed)
    return df.withColumn("type", F.when(F.coalesce(pick, F.lit(False)), F.lit(type_)).otherwise(F.col("type")))


def remove_particles(df: DataFrame, domain: Domain, regions=None, region=None, fraction=None, count=None, seed: int = 0) -> DataFrame:
    """Rows that aren't chosen; ids stay as they are."""
    return df.where(~F.coalesce(chosen(df, eligible(domain, regions, region), fraction, count, seed), F.lit(False)))


def remove_close(df: DataFrame, domain: Domain, distance: float, seed: int = 0) -> DataFrame:
    """Without the particles that have a neighbour of smaller key nearer than the distance (grid space, strict).

    One pass: of a chain A-B-C more may go than needed. Particles at one place are
    no neighbours; a particle's own image never removes it.
    """
    flat = domain.override(xform=(1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0))
    pairs = neighbors(df, flat, distance).where((F.col("d2") < distance * distance) & (F.col("a") != F.col("b")))
    key = lambda c: F.struct(uniform_key(F.col(c), seed), F.col(c))
    gone = pairs.where(key("b") < key("a")).select(F.col("a").alias("id")).distinct()
    return df.join(gone, "id", "left_anti")


def clear(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))
