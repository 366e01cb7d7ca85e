"""Which regions hold which points: adaptive cell coverage, then equi-joins.

Every region (box, quadric, id range) is covered by cells of an octree over the
domain. A cell proven to lie wholly inside is interior: its points are accepted
by the join alone. A cell that can't be decided is boundary: only its points get
the exact test. Cells proven outside are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.domain import AXES, Domain

OUTSIDE = -1
COVER = "__row int, level int, kx int, ky int, kz int, interior boolean"


@dataclass(frozen=True)
class Shape:
    region_id: int
    bmin: tuple[float, ...] | None
    bmax: tuple[float, ...] | None
    quadric: tuple[float, ...] | None
    id_start: int | None = None
    id_end: int | None = None


def quadric_value(q: list[Column] | Column, x: Column, y: Column, z: Column) -> Column:
    """(r,1) Q (r,1)^T for a row-major 4x4 array column or 16 columns."""
    m = [q[i] for i in range(16)]
    v = (x, y, z, F.lit(1.0))
    rows = [sum((m[4 * i + j] * v[j] for j in range(1, 4)), m[4 * i] * v[0]) * v[i] for i in range(4)]
    return rows[0] + rows[1] + rows[2] + rows[3]


def quadric_bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals that hold the quadric's values over the boxes lo..hi (n x 3), widened for rounding."""
    a, b, c = (q[:3, :3] + q[:3, :3].T) / 2, (q[:3, 3] + q[3, :3]) / 2, q[3, 3]
    mid, half = (lo + hi) / 2, (hi - lo) / 2
    at = np.einsum("ni,ij,nj->n", mid, a, mid) + 2 * mid @ b + c
    slope = (np.abs(2 * (mid @ a + b)) * half).sum(1)
    square = half[:, :, None] * half[:, None, :] * a
    diag = np.einsum("nii->ni", square)
    cross = np.abs(square).sum((1, 2)) - np.abs(diag).sum(1)
    reach = np.maximum(1.0, np.maximum(np.abs(lo), np.abs(hi)).max(1))
    pad = 1e-9 * (np.abs(a).sum() * reach**2 + np.abs(b).sum() * reach + abs(c))
    return at - slope - cross + np.minimum(diag, 0).sum(1) - pad, at + slope + cross + np.maximum(diag, 0).sum(1) + pad


def classify(shape: Shape, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For closed boxes lo..hi (n x 3): which lie wholly inside the shape, which wholly outside."""
    pad = 1e-12 * max(1.0, float(np.abs([lo, hi]).max()))
    lo, hi = lo - pad, hi + pad  # the join's key rounds
    inner, outer = np.ones(len(lo), bool), np.zeros(len(lo), bool)
    if shape.bmin is not None:
        outer |= (hi < np.array(shape.bmin)).any(1)
        inner &= (lo >= np.array(shape.bmin)).all(1)
    if shape.bmax is not None:
        outer |= (lo > np.array(shape.bmax)).any(1)
        inner &= (hi <= np.array(shape.bmax)).all(1)
    if shape.quadric is not None:
        least, most = quadric_bounds(np.array(shape.quadric, float).reshape(4, 4), lo, hi)
        outer |= least > 0
        inner &= most <= 0
    return inner & ~outer, outer


def cover(shape: Shape, domain: Domain, max_cells: int = 2048, max_level: int = 8) -> list[tuple]:
    """At most max_cells cells of a region, the undecided ones split level by level while that bound allows.

    Points outside the bounds fall in one pseudo cell of level OUTSIDE, a boundary cell of every region.
    """
    base, size = np.array(domain.bmin), np.array(domain.size)
    corners = np.array(list(np.ndindex(2, 2, 2)))
    done, cells = [(shape.region_id, OUTSIDE, 0, 0, 0, False)], np.zeros((1, 3), int)
    for level in range(max_level + 1):
        if not len(cells):
            break
        step = size / 2**level
        inner, outer = classify(shape, base + cells * step, base + (cells + 1) * step)
        done += [(shape.region_id, level, *map(int, k), True) for k in cells[inner]]
        cells = cells[~inner & ~outer]
        if level == max_level or len(done) + 8 * len(cells) > max_cells:
            return done + [(shape.region_id, level, *map(int, k), False) for k in cells]
        cells = (2 * cells[:, None, :] + corners).reshape(-1, 3)
    return done


#: Cells of the coverage that one join broadcasts at most, some three megabytes; more regions are joined in further parts.
PART_CELLS = 50_000


def covers(regions: DataFrame, domain: Domain, max_cells: int, max_level: int) -> Iterator[tuple[list[tuple], list[tuple]]]:
    """The regions, numbered by row, and their coverage, in parts of at most PART_CELLS cells (one region's cells stay together).

    Regions come to the driver one partition at a time; nothing of the points does.
    """
    tup = lambda v: None if v is None else tuple(v)
    rows: list[tuple] = []
    part: list[tuple] = []
    for n, r in enumerate(regions.select("region_id", "id_start", "id_end", "bmin", "bmax", "quadric").toLocalIterator()):
        cells = cover(Shape(n, tup(r.bmin), tup(r.bmax), tup(r.quadric)), domain, max_cells, max_level)
        if part and len(part) + len(cells) > PART_CELLS:
            yield rows, part
            rows, part = [], []
        rows.append((n, *r))
        part += cells
    yield rows, part


def regions_of_points(points: DataFrame, regions: DataFrame, domain: Domain, max_cells: int = 2048, max_level: int = 8) -> DataFrame:
    """Distinct (id, region_id) for rows of `points` (id, rx, ry, rz) that lie in a region.

    A row lies in a region if id_start <= id < id_end, bmin <= r <= bmax and
    (r,1) Q (r,1)^T <= 0, on wrapped positions; a null restriction restricts
    nothing. Rows with null id or a null or non-finite coordinate take no part.
    A region_id that stands in several rows has the points of each. The coverage
    is broadcast in parts of at most PART_CELLS rows, with a pass over the points
    each.
    """
    parts = [_of_part(points, regions, domain, *part) for part in covers(regions, domain, max_cells, max_level)]
    return reduce(DataFrame.unionByName, parts).distinct()


def _of_part(points: DataFrame, regions: DataFrame, domain: Domain, rows: list[tuple], cells: list[tuple]) -> DataFrame:
    spark = points.sparkSession
    covered = F.broadcast(spark.createDataFrame(cells, COVER))
    levels = sorted({c[1] for c in cells if c[1] != OUTSIDE})
    kind = regions.schema["region_id"].dataType.simpleString()
    limits = F.broadcast(spark.createDataFrame(rows, f"__row int, region_id {kind}, id_start long, id_end long, bmin array<double>, bmax array<double>, quadric array<double>"))
    r = [F.col(f"r{a}") for a in AXES]
    finite = F.col("id").isNotNull()
    for c in r:
        finite = finite & (F.abs(c) < float("inf"))
    p = points.select(F.col("id").cast("long").alias("id"), *(c.cast("double").alias(f"r{a}") for c, a in zip(r, AXES))).where(finite)
    w = p.select("id", *(domain.wrapped(i, F.col(f"r{a}")).alias(a) for i, a in enumerate(AXES)))
    within = domain.inside([F.col(a) for a in AXES])
    key = lambda level, i: F.floor((F.col(AXES[i]) - domain.bmin[i]) / (domain.size[i] / 2**level)).cast("int")
    struct = lambda level: F.struct(F.lit(level).alias("level"), *(key(level, i).alias(f"k{a}") for i, a in enumerate(AXES)))
    nowhere = F.array(F.struct(F.lit(OUTSIDE).alias("level"), *(F.lit(0).alias(f"k{a}") for a in AXES)))
    keys = F.when(within, F.array(*(struct(level) for level in levels))).otherwise(nowhere) if levels else nowhere
    hit = w.select("id", *AXES, F.inline(keys)).join(covered, ["level", "kx", "ky", "kz"])
    near = hit.join(limits, "__row")
    ids = F.coalesce(F.col("id") >= F.col("id_start"), F.lit(True)) & F.coalesce(F.col("id") < F.col("id_end"), F.lit(True))
    exact = F.lit(True)
    for i, a in enumerate(AXES):
        exact = exact & F.coalesce(F.col(a) >= F.col("bmin")[i], F.lit(True)) & F.coalesce(F.col(a) <= F.col("bmax")[i], F.lit(True))
    exact = exact & F.coalesce(quadric_value(F.col("quadric"), *(F.col(a) for a in AXES)) <= 0, F.lit(True))
    return near.where(ids & (F.col("interior") | exact)).select("id", "region_id")
