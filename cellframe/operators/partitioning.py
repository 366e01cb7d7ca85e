"""Where rows lie: z-order ranges, balance, and periodic images. None changes an answer."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.domain import AXES, Domain


def z_order_key(domain: Domain) -> Column:
    """Bits of the cell indices interleaved."""
    bits = max(1, max(d - 1 for d in domain.grid_dims).bit_length())
    key = F.lit(0).cast("long")
    for b in range(bits):
        for i, c in enumerate(("ci", "cj", "ck")):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(F.greatest(F.col(c), F.lit(0)).cast("long"), b).bitwiseAND(F.lit(1).cast("long")), 3 * b + i))
    return key


def partition_by_cells(df: DataFrame, domain: Domain, parts: int) -> DataFrame:
    """Rows range-partitioned by z-order: cells near each other lie together, heavy ranges are cut by the sample."""
    keyed = domain.with_cells(df, ("ci", "cj", "ck")).withColumn("__z", z_order_key(domain))
    return keyed.repartitionByRange(parts, "__z", "id").drop("__z")


def imbalance(df: DataFrame) -> DataFrame:
    """(greatest - mean) / mean of the partitions' rows."""
    n = df.groupBy(F.spark_partition_id().alias("part")).count()
    return n.agg(((F.max("count") - F.avg("count")) / F.avg("count")).alias("imbalance"), F.count("*").alias("parts"))


def _halves(lo, hi, n: int, weigh: Callable) -> list[tuple]:
    """(start, end, cost) of n blocks: the longest side is cut where weigh(axis, start, end) says."""
    axis = max(range(3), key=lambda a: hi[a] - lo[a])
    cost, cut = weigh(axis, lo, hi, n)
    if n == 1 or hi[axis] - lo[axis] < 2:
        return [(lo, hi, cost)]
    cut = min(max(cut, lo[axis] + 1), hi[axis] - 1)
    put = lambda v, x: tuple(x if a == axis else y for a, y in enumerate(v))
    return _halves(lo, put(hi, cut), n // 2, weigh) + _halves(put(lo, cut), hi, n - n // 2, weigh)


def even_blocks(domain: Domain, parts: int, draw: Callable[[int], float] | None = None) -> list[tuple]:
    """Blocks (start, end, cells) of about equal volume; with `draw` (a number in [0, 1) by the count of cuts) of random ones."""
    made = itertools.count()

    def weigh(axis, lo, hi, n):
        share = (n // 2) / n if draw is None or n == 1 else 0.1 + 0.8 * draw(next(made))
        return float(math.prod(b - a for a, b in zip(lo, hi))), lo[axis] + round((hi[axis] - lo[axis]) * share)

    return _halves((0, 0, 0), tuple(domain.grid_dims), parts, weigh)


#: Cells of the coarse cost table along an axis at most: the driver gets their cube of rows, 32,768.
COARSE = 32


def recursive_bisection(costs: DataFrame, domain: Domain, parts: int) -> list[tuple[tuple[int, int, int], tuple[int, int, int], float]]:
    """Blocks (start, end, cost) of cells of about equal cost, the longest side cut first.

    One distributed aggregate gives the cost of coarse cells (COARSE an axis at
    most); all cuts are made from it on the driver, at faces of coarse cells.
    Rows outside the grid cost nothing.
    """
    steps = [max(1, math.ceil(d / COARSE)) for d in domain.grid_dims]
    coarse = [F.floor(F.col(c) / s).cast("int").alias(c) for c, s in zip(("ci", "cj", "ck"), steps)]
    inside = F.lit(True)
    for c, d in zip(("ci", "cj", "ck"), domain.grid_dims):
        inside = inside & (F.col(c) >= 0) & (F.col(c) < d)
    size = tuple(math.ceil(d / s) for d, s in zip(domain.grid_dims, steps))
    held = np.zeros(size)
    for i, j, k, cost in costs.where(inside).groupBy(*coarse).agg(F.sum("cost")).collect():
        held[i, j, k] = cost

    def weigh(axis, lo, hi, n):
        part = held[tuple(slice(a, b) for a, b in zip(lo, hi))]
        slabs = part.sum(tuple(a for a in range(3) if a != axis))
        run, want = np.concatenate([[0.0], np.cumsum(slabs)]), part.sum() * (n // 2) / n
        return float(part.sum()), lo[axis] + int(np.abs(run - want).argmin())

    fine = lambda v: tuple(min(x * s, d) for x, s, d in zip(v, steps, domain.grid_dims))
    return [(fine(lo), fine(hi), c) for lo, hi, c in _halves((0, 0, 0), size, parts, weigh)]


def owner(blocks, names=("ci", "cj", "ck")) -> Column:
    """The number of the block that holds a cell, null outside all; the expression is as long as the list of blocks."""
    out = F.lit(None).cast("int")
    for n, (lo, hi, *_) in reversed(list(enumerate(blocks))):
        inside = F.lit(True)
        for c, a, b in zip(names, lo, hi):
            inside = inside & (F.col(c) >= a) & (F.col(c) < b)
        out = F.when(inside, F.lit(n)).otherwise(out)
    return out


def partition_by_owner(df: DataFrame, domain: Domain, blocks) -> DataFrame:
    """Rows range-partitioned by the block that owns their cell, then by id: a block with many rows is cut in several parts."""
    marked = domain.with_cells(df, ("__ci", "__cj", "__ck")).withColumn("__owner", owner(blocks, ("__ci", "__cj", "__ck")))
    return marked.repartitionByRange(len(blocks), "__owner", "id").select(*df.columns)


def two_speeds(counts: DataFrame, ratio: float = 8.0, least: int = 16, bins: int = 1024) -> DataFrame:
    """ci, cj, ck, n, fast: the fullest cells of at least `least` particles go to the fast side until it has ratio / (1 + ratio) of all.

    The cut is the particle count of a bin of a histogram with at most `bins` rows.
    """
    top = counts.agg(F.max("n")).first()[0] or 1
    step = max(1, math.ceil((top + 1) / bins))
    held = dict(counts.groupBy(F.floor(F.col("n") / step).alias("b")).agg(F.sum("n")).collect())
    want, run, cut = ratio / (1 + ratio) * sum(held.values()), 0, top + 1
    for b in sorted(held, reverse=True):
        if run + held[b] > want and run:
            break
        run, cut = run + held[b], b * step
    return counts.withColumn("fast", (F.col("n") >= max(cut, least)))


def sub_grids(counts: DataFrame, density: float = 5.0, least: int = 1) -> DataFrame:
    """ci, cj, ck, n, side: how many sub-cells an axis of a cell is cut into so that each has about `density` particles."""
    side = F.greatest(F.floor(F.cbrt(F.col("n") / density)), F.lit(max(1, least)))
    return counts.select("ci", "cj", "ck", "n", side.cast("int").alias("side"))


def periodic_images(df: DataFrame, domain: Domain, distance: float, mirrors: bool = True) -> DataFrame:
    """The particles' images within a distance outside the box, marked by ix, iy, iz; the particles themselves have 0, 0, 0.

    A mirrored side reflects positions (and velocities) instead of shifting them.
    """
    out = df.withColumn("is_ghost", F.lit(False))
    for i, a in enumerate(AXES):
        lo, hi, r = domain.bmin[i], domain.bmax[i], F.col(f"r{a}")
        copies = [F.struct(F.lit(0).alias("i"), r.alias("r"), F.lit(1.0).alias("m"))]
        if domain.periodic[i]:
            copies += [F.when(r + k * domain.size[i] >= lo - distance, F.when(r + k * domain.size[i] < hi + distance, F.struct(F.lit(k).alias("i"), (r + k * domain.size[i]).alias("r"), F.lit(1.0).alias("m")))) for k in (-1, 1)]
        elif mirrors:
            for side, k, at in (("-", -1, lo), ("+", 1, hi)):
                if a + side in domain.mirror:
                    copies.append(F.when(F.abs(r - at) < distance, F.struct(F.lit(k).alias("i"), (2 * at - r).alias("r"), F.lit(-1.0).alias("m"))))
        out = out.withColumn("__c", F.explode(F.filter(F.array(*copies), lambda c: c.isNotNull())))
        change = {f"i{a}": F.col("__c.i"), f"r{a}": F.col("__c.r"), "is_ghost": F.col("is_ghost") | (F.col("__c.i") != 0)}
        if f"v{a}" in df.columns:
            change[f"v{a}"] = F.col(f"v{a}") * F.col("__c.m")
        out = out.withColumns(change).drop("__c")
    return out


def sum_from_images(df: DataFrame, fields: list[str]) -> DataFrame:
    """Fields of the images added to their particles: one row an id."""
    return df.groupBy("id").agg(*(F.sum(f).alias(f) for f in fields))


def add_from_images(df: DataFrame, images: DataFrame, names: list[str]) -> DataFrame:
    """Fields of the images added to the fields of the particles that they are images of."""
    sums = images.groupBy("id").agg(*(F.sum(n).alias(f"__{n}") for n in names))
    joined = df.join(sums, "id", "left")
    return joined.withColumns({n: F.col(n) + F.coalesce(F.col(f"__{n}"), F.lit(0.0)) for n in names}).select(*df.columns)


def neighbour_blocks(blocks, distance_cells: int, domain: Domain | None = None) -> list[tuple[int, int]]:
    """Pairs of blocks that meet once both are enlarged by a number of cells, across the periodic faces of a domain too."""
    out = []
    shifts = itertools.product(*((-d, 0, d) if domain is not None and p else (0,) for d, p in zip(domain.grid_dims, domain.periodic))) if domain is not None else [(0, 0, 0)]
    shifts = list(shifts)
    for (i, a), (j, b) in itertools.combinations(enumerate(blocks), 2):
        if any(all(a[0][k] - distance_cells < b[1][k] + o[k] and b[0][k] + o[k] < a[1][k] + distance_cells for k in range(3)) for o in shifts):
            out.append((i, j))
    return out
