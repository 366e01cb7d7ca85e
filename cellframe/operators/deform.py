"""Deformation of space: driver-side 3x3 matrices that end in a domain's xform."""

from __future__ import annotations

import numpy as np

from cellframe.domain import Domain
from cellframe.functions.curves import Spline, piecewise_linear


def from_angles(angles, extension=(1.0, 1.0, 1.0)) -> np.ndarray:
    """Columns are the edges of a cell with the given angles (radians) between them, stretched by the extension."""
    al, bt, gm = angles
    for s in ((1, 1, 1), (-1, 1, 1), (1, -1, 1), (1, 1, -1)):
        total = s[0] * al + s[1] * bt + s[2] * gm
        if not 0.0 <= total <= 2 * np.pi:
            raise ValueError("no cell has these angles")
    ca, cb, cg, sg = np.cos(al), np.cos(bt), np.cos(gm), np.sin(gm)
    x = (ca - cb * cg) / sg
    edges = np.array([[1.0, cg, cb], [0.0, sg, x], [0.0, 0.0, np.sqrt(max(0.0, 1 - cb * cb - x * x))]])
    return edges @ np.diag(extension)


def deformed(domain: Domain, matrix, mode: str = "SET") -> Domain:
    """SET, PREMULTIPLY, POSTMULTIPLY or IGNORE a matrix on the domain's xform."""
    m, x = np.asarray(matrix, float).reshape(3, 3), domain.matrix
    new = {"SET": m, "PREMULTIPLY": m @ x, "POSTMULTIPLY": x @ m, "IGNORE": x}[mode]
    return domain.override(xform=tuple(new.ravel().tolist()))


def strain(mode: str, rate: float, elapsed: float, directions, signs=(1.0, 1.0, 1.0)) -> np.ndarray:
    """I + sum of sign * rate * elapsed * m (x) m over the directions of the mode; shear takes m (x) n."""
    f = np.eye(3)
    if elapsed < 0:
        return f
    if mode == "shear":
        return f + signs[0] * rate * elapsed * np.outer(directions[0], directions[1])
    n = {"uniaxial": 1, "biaxial": 2, "triaxial": 3}[mode]
    for d, s in list(zip(directions, signs))[:n]:
        f = f + s * rate * elapsed * np.outer(d, d)
    return f


def strain_step(domain: Domain, mode: str, rate: float, dt: float, timestep: int, directions=((1, 0, 0), (0, 1, 0), (0, 0, 1)), signs=(1.0, 1.0, 1.0), time_start: float = 0.0, predef=(1.0, 1.0, 1.0)) -> tuple[Domain, np.ndarray]:
    """The domain after one step of constant strain rate, and the strain so far."""
    now, before = dt * timestep - time_start, dt * (timestep - 1) - time_start
    f = strain(mode, rate, now, directions, signs)
    last = strain(mode, rate, before, directions, signs) if now >= 0 else np.eye(3)
    return deformed(domain, f @ np.linalg.inv(last) @ np.diag(predef), "PREMULTIPLY"), f


def interpolated(times, matrices, t: float) -> np.ndarray:
    """Each element by a natural cubic spline over time."""
    m = np.asarray(matrices, float).reshape(len(times), 9)
    return np.array([Spline(times, c)(t) for c in m.T]).reshape(3, 3)


def interpolated_by_parts(times, matrices, t: float) -> np.ndarray:
    """Each element piecewise linear over time, constant beyond the ends."""
    m = np.asarray(matrices, float).reshape(len(times), 9)
    return np.array([piecewise_linear(times, c, t) for c in m.T]).reshape(3, 3)


def by_parts_step(domain: Domain, times, matrices, dt: float, timestep: int) -> Domain:
    t = dt * timestep
    return deformed(domain, interpolated_by_parts(times, matrices, t) @ np.linalg.inv(interpolated_by_parts(times, matrices, t - dt)), "PREMULTIPLY")
