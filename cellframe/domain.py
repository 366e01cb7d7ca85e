"""Simulation domain: bounds, cells, periodic axes and the linear deformation of space."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Domain:
    """A box of cubic cells. `xform` maps grid space to lab space, row by row.

    mirror holds names like "x-" or "z+"; a mirrored axis can't be periodic.
    """

    bmin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    bmax: tuple[float, float, float] = (1.0, 1.0, 1.0)
    grid_dims: tuple[int, int, int] = (1, 1, 1)
    cell_size: float = 1.0
    periodic: tuple[bool, bool, bool] = (False, False, False)
    mirror: frozenset[str] = field(default_factory=frozenset)
    expandable: bool = False
    xform: tuple[float, ...] = IDENTITY

    def __post_init__(self):
        for m in self.mirror:
            if m not in {a + s for a in AXES for s in "+-"}:
                raise ValueError(f"unknown mirror side {m!r}")
            if self.periodic[AXES.index(m[0])]:
                raise ValueError(f"axis {m[0]} is periodic and mirrored")
        if abs(np.linalg.det(self.matrix)) < 1e-300:
            raise ValueError("xform can't be inverted")

    @classmethod
    def cube(cls, size: float, cells: int, periodic=(True, True, True), origin: float = 0.0, **more) -> Domain:
        return cls((origin,) * 3, (origin + size,) * 3, (cells,) * 3, size / cells, tuple(periodic), **more)

    @classmethod
    def from_row(cls, row) -> Domain:
        """From a row of sim_domain: bmin, bmax, grid_dims, cell_size, periodic, expandable, xform."""
        return cls(tuple(row["bmin"]), tuple(row["bmax"]), tuple(row["grid_dims"]), row["cell_size"], tuple(row["periodic"]), expandable=row["expandable"], xform=tuple(row["xform"]))

    @property
    def matrix(self) -> np.ndarray:
        return np.array(self.xform, float).reshape(3, 3)

    @property
    def inverse(self) -> tuple[float, ...]:
        return tuple(np.linalg.inv(self.matrix).ravel().tolist())

    @property
    def size(self) -> tuple[float, float, float]:
        return tuple(hi - lo for lo, hi in zip(self.bmin, self.bmax))

    @property
    def is_identity(self) -> bool:
        return tuple(self.xform) == IDENTITY

    @property
    def scales(self) -> tuple[float, float]:
        """Smallest and largest stretch of the deformation."""
        s = np.linalg.svd(self.matrix, compute_uv=False)
        return float(s[-1]), float(s[0])

    def volume(self) -> float:
        """Lab volume: determinant of xform times the volume of the bounds."""
        return float(np.linalg.det(self.matrix)) * math.prod(self.size)

    def override(self, **changes) -> Domain:
        return replace(self, **changes)

    def updated(self) -> Domain:
        """Cells made to agree with the bounds: the bounds stay, cubic cells no smaller than cell_size divide them."""
        if self.cell_size <= 0:
            raise ValueError("cell_size must be positive")
        dims = [max(1, math.floor(s / self.cell_size + 1e-9)) for s in self.size]
        longest = max(range(3), key=lambda a: self.size[a])
        cell = self.size[longest] / dims[longest]
        dims = [max(1, round(s / cell)) for s in self.size]
        bmax = tuple(lo + n * cell for lo, n in zip(self.bmin, dims))
        return replace(self, grid_dims=tuple(dims), cell_size=cell, bmax=bmax)

    def check(self, tolerance: float = 1e-12) -> Domain:
        """Raises if grid_dims times cell_size isn't the size of the bounds."""
        for s, n in zip(self.size, self.grid_dims):
            if abs(n * self.cell_size - s) > tolerance * max(1.0, abs(s)):
                raise ValueError(f"{n} cells of {self.cell_size} don't fill {s}")
        return self

    def wrapped(self, axis: int, r: Column) -> Column:
        """The coordinate brought back into [bmin, bmax) if the axis is periodic."""
        if not self.periodic[axis]:
            return r
        lo, length = self.bmin[axis], self.size[axis]
        return F.pmod(r - F.lit(lo), F.lit(length)) + F.lit(lo) if lo else F.pmod(r, F.lit(length))

    def cell_of(self, axis: int, wrapped: Column) -> Column:
        return F.floor((wrapped - F.lit(self.bmin[axis])) / F.lit(self.cell_size)).cast("int")

    def wrap(self, df: DataFrame) -> DataFrame:
        """rx, ry, rz brought back into the box along periodic axes. Null and NaN stay."""
        return df.withColumns({f"r{a}": self.wrapped(i, F.col(f"r{a}")) for i, a in enumerate(AXES) if self.periodic[i]}) if any(self.periodic) else df

    def with_cells(self, df: DataFrame, names=("ci", "cj", "ck")) -> DataFrame:
        """Adds the cell indices of wrapped positions. Rows outside a closed axis get indices outside the grid."""
        return df.withColumns({n: self.cell_of(i, self.wrapped(i, F.col(f"r{a}"))) for i, (n, a) in enumerate(zip(names, AXES))})

    def inside(self, wrapped: list[Column]) -> Column:
        """Half-open test against the bounds."""
        tests = [(w >= F.lit(lo)) & (w < F.lit(hi)) for w, lo, hi in zip(wrapped, self.bmin, self.bmax)]
        return tests[0] & tests[1] & tests[2]


def init_domain(bmin, bmax, periodic=(True, True, True), cell_size: float = 0.0, ghost_dist: float = 8.8, auto_cell_size_factor: float = 2.0, default_cell_size: float | None = None, **more) -> Domain:
    """A domain whose missing cell size comes from the default, or from the ghost distance times a factor."""
    size = cell_size or default_cell_size or ghost_dist * auto_cell_size_factor
    return Domain(tuple(bmin), tuple(bmax), (1, 1, 1), size, tuple(periodic), **more).updated()


def extend_domain(domain: Domain, lo: tuple[float, float, float], hi: tuple[float, float, float]) -> tuple[Domain, bool]:
    """Grows closed axes of an expandable domain by at most one cell a side, so that lo and hi lie inside.

    Raises if a position lies farther out. Returns the domain and whether it changed.
    """
    bmin, bmax, dims, grown = list(domain.bmin), list(domain.bmax), list(domain.grid_dims), False
    if not domain.expandable:
        return domain, False
    for a in range(3):
        if domain.periodic[a]:
            continue
        if lo[a] < bmin[a] - domain.cell_size or hi[a] >= bmax[a] + domain.cell_size:
            raise ValueError(f"a particle is more than one cell outside along {AXES[a]}")
        if lo[a] < bmin[a]:
            bmin[a], dims[a], grown = bmin[a] - domain.cell_size, dims[a] + 1, True
        if hi[a] >= bmax[a]:
            bmax[a], dims[a], grown = bmax[a] + domain.cell_size, dims[a] + 1, True
    return (replace(domain, bmin=tuple(bmin), bmax=tuple(bmax), grid_dims=tuple(dims)), True) if grown else (domain, False)
