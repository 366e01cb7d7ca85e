"""Named regions, and boolean expressions over their names compiled to Catalyst predicates."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NAME_LENGTH = 12
IDENTITY4 = np.eye(4)

# Quadrics of the unit shapes; a point is inside where the form is not above 0.
SHAPES = {
    "sphere": np.diag([1.0, 1.0, 1.0, -1.0]),
    "cylx": np.diag([0.0, 1.0, 1.0, -1.0]),
    "cyly": np.diag([1.0, 0.0, 1.0, -1.0]),
    "cylz": np.diag([1.0, 1.0, 0.0, -1.0]),
    "conex": np.diag([-1.0, 1.0, 1.0, 0.0]),
    "coney": np.diag([1.0, -1.0, 1.0, 0.0]),
    "conez": np.diag([1.0, 1.0, -1.0, 0.0]),
}


def plane(normal: Sequence[float], offset: float) -> np.ndarray:
    """Half space n.r + offset <= 0."""
    q = np.zeros((4, 4))
    q[:3, 3] = q[3, :3] = np.asarray(normal, float) / 2
    q[3, 3] = offset
    return q


def translation(v) -> np.ndarray:
    m = np.eye(4)
    m[:3, 3] = v
    return m


def scaling(v) -> np.ndarray:
    return np.diag([*np.broadcast_to(np.asarray(v, float), 3), 1.0])


def rotation(axis: str, angle: float) -> np.ndarray:
    i, j = {"x": (1, 2), "y": (2, 0), "z": (0, 1)}[axis]
    m = np.eye(4)
    m[i, i] = m[j, j] = np.cos(angle)
    m[i, j], m[j, i] = -np.sin(angle), np.sin(angle)
    return m


def transformed(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The quadric of the shape moved by m."""
    inv = np.linalg.inv(m)
    return inv.T @ q @ inv


@dataclass(frozen=True)
class Region:
    """An id range, a closed box and a quadric; what is None restricts nothing."""

    name: str
    id_start: int | None = None
    id_end: int | None = None
    bmin: tuple[float, float, float] | None = None
    bmax: tuple[float, float, float] | None = None
    quadric: tuple[float, ...] | None = None

    def holds(self, r, id_: Column | None) -> Column:
        tests = []
        if self.id_start is not None and id_ is not None:
            tests.append(id_ >= self.id_start)
        if self.id_end is not None and id_ is not None:
            tests.append(id_ < self.id_end)
        tests += [x >= float(lo) for x, lo in zip(r, self.bmin or ())]
        tests += [x <= float(hi) for x, hi in zip(r, self.bmax or ())]
        if self.quadric is not None:
            tests.append(quadric_column(self.quadric, r) <= 0)
        out = F.lit(True)
        for t in tests:
            out = out & t
        return out


def quadric_column(q: Sequence[float], r) -> Column:
    """(r,1) Q (r,1)^T; entries of 0 leave no trace in the plan."""
    v = [*r, None]
    terms = []
    for i in range(4):
        for j in range(i, 4):
            c = float(q[4 * i + j]) + (float(q[4 * j + i]) if i != j else 0.0)
            if c:
                term = F.lit(c)
                for k in (i, j):
                    term = term * v[k] if v[k] is not None else term
                terms.append(term)
    return sum(terms[1:], terms[0]) if terms else F.lit(0.0)


@dataclass(frozen=True)
class Regions:
    """Registry of regions; a later region replaces one of its name.

    A name that isn't known stands for the one region that begins with the same
    NAME_LENGTH characters, as older decks cut names there; two such regions raise.
    """

    known: dict[str, Region] = field(default_factory=dict)

    def declare(self, name: str, bounds=None, quadric=None, transform=None, id_range=None) -> Regions:
        """`quadric` is a shape's name or a 4x4 matrix, `transform` a 4x4 matrix that moves it."""
        q = None
        if quadric is not None:
            q = SHAPES[quadric] if isinstance(quadric, str) else np.asarray(quadric, float).reshape(4, 4)
            q = tuple(transformed(q, IDENTITY4 if transform is None else transform).ravel().tolist())
        lo, hi = bounds if bounds is not None else (None, None)
        start, end = id_range if id_range is not None else (None, None)
        return replace(self, known=self.known | {name: Region(name, start, end, lo and tuple(lo), hi and tuple(hi), q)})

    def find(self, name: str) -> Region | None:
        if name in self.known or len(name) < NAME_LENGTH:
            return self.known.get(name)
        alike = [r for n, r in self.known.items() if n[:NAME_LENGTH] == name[:NAME_LENGTH]]
        if len(alike) > 1:
            raise ValueError(f"region {name!r} may be any of {[r.name for r in alike]}")
        return alike[0] if alike else None

    def predicate(self, expression: str | None, r, id_: Column | None = None) -> Column:
        """The Column of an expression of names, and, or, not and parentheses; an empty one accepts all.

        not binds tightest, then and, then or. An unknown name raises. Where a
        position or id that the named regions look at is null the predicate is false,
        by conjuncts of its own: comparisons still reach the scan.
        """
        tokens = re.findall(r"[()]|[^\s()]+", expression or "")
        if not tokens:
            return F.lit(True)
        column, rest = self._either(tokens, r, id_)
        if rest:
            raise ValueError(f"unexpected {rest[0]!r} in region expression {expression!r}")
        used = [q for t in tokens if t not in ("and", "or", "not", "(", ")") and (q := self.find(t))]
        looked = [*r] if any(q.bmin or q.bmax or q.quadric for q in used) else []
        if id_ is not None and any(q.id_start is not None or q.id_end is not None for q in used):
            looked.append(id_)
        for c in looked:
            column = c.isNotNull() & column
        return column

    def _either(self, tokens, r, id_):
        left, tokens = self._both(tokens, r, id_)
        while tokens[:1] == ["or"]:
            right, tokens = self._both(tokens[1:], r, id_)
            left = left | right
        return left, tokens

    def _both(self, tokens, r, id_):
        left, tokens = self._one(tokens, r, id_)
        while tokens[:1] == ["and"]:
            right, tokens = self._one(tokens[1:], r, id_)
            left = left & right
        return left, tokens

    def _one(self, tokens, r, id_):
        if not tokens or tokens[0] in ("and", "or", ")"):
            raise ValueError("a region expression ends too early")
        head, tokens = tokens[0], tokens[1:]
        if head == "not":
            inner, tokens = self._one(tokens, r, id_)
            return ~inner, tokens
        if head == "(":
            inner, tokens = self._either(tokens, r, id_)
            if tokens[:1] != [")"]:
                raise ValueError("a parenthesis isn't closed")
            return inner, tokens[1:]
        found = self.find(head)
        if found is None:
            raise KeyError(f"unknown region {head!r}")
        return found.holds(r, id_), tokens


def located(regions: Regions | None, region: str | None, r, id_=None, mask: Column | None = None, mask_value: float | None = None, source=None, threshold: float = 0.0, time: float = 0.0) -> Column:
    """Region and mask value and source function not below a threshold: the filter that generators and noise share."""
    out = (regions or Regions()).predicate(region, r, id_)
    if mask is not None:
        out = out & F.coalesce(mask == F.lit(float(1.0 if mask_value is None else mask_value)), F.lit(False))
    if source is not None:
        out = out & (source(r, time) >= threshold)
    return out
