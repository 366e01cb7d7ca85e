"""Vector columns: a Vec3 is a tuple of three Columns, a Mat3 nine numbers or Columns row by row."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
Vec = tuple[Column, Column, Column]

# Factors to metre, second, kilogram, kelvin and radian based units.
UNITS = {"m": 1.0, "mm": 1e-3, "um": 1e-6, "nm": 1e-9, "ang": 1e-10, "s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9, "ps": 1e-12, "fs": 1e-15, "kg": 1.0, "g": 1e-3, "Da": 1.66053904020e-27, "K": 1.0, "eV": 1.6021892e-19, "J": 1.0, "rad": 1.0, "degree": math.pi / 180}


def quantity(text: str | float, units: dict[str, float] | None = None) -> float:
    """A number with a unit, such as "3 ang", "1.5 eV" or "2 m/s^2", in the internal units (SI unless given)."""
    if isinstance(text, (int, float)):
        return float(text)
    number, _, unit = text.strip().partition(" ")
    value, known = float(number), units or UNITS
    for sign, name, power in re.findall(r"([*/.]?)\s*([A-Za-z]+)(?:\^(-?\d+))?", unit):
        if name not in known:
            raise ValueError(f"unknown unit {name!r}")
        value *= known[name] ** (int(power or 1) * (-1 if sign == "/" else 1))
    return value


def vec(prefix: str, names: Sequence[str] = AXES) -> Vec:
    return tuple(F.col(f"{prefix}{a}") for a in names)


def lits(v: Sequence[float]) -> Vec:
    return tuple(F.lit(float(x)) for x in v)


def dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a, b) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def add(a, b) -> Vec:
    return tuple(x + y for x, y in zip(a, b))


def sub(a, b) -> Vec:
    return tuple(x - y for x, y in zip(a, b))


def scaled(a, s) -> Vec:
    return tuple(x * s for x in a)


def norm2(a) -> Column:
    return dot(a, a)


def norm(a) -> Column:
    return F.sqrt(norm2(a))


def matvec(m: Sequence[float], v: Vec) -> Vec:
    """Literal 3x3 matrix times a vector; entries of 0 and 1 leave no trace in the plan."""
    out = []
    for i in range(3):
        terms = [v[j] if m[3 * i + j] == 1.0 else F.lit(float(m[3 * i + j])) * v[j] for j in range(3) if m[3 * i + j] != 0.0]
        out.append(sum(terms[1:], terms[0]) if terms else F.lit(0.0))
    return tuple(out)


def constant_source(value: float):
    return lambda r, t=0.0: F.lit(float(value))


def null_source():
    return constant_source(0.0)


def sphere_source(center, amplitude, radius_mean, radius_dev, time_mean, time_dev):
    """Gaussian in the distance to a centre and in time."""

    def f(r, t=0.0):
        x = norm(sub(r, lits(center))) - radius_mean
        y = F.lit(float(t) - time_mean)
        return F.lit(float(amplitude)) * F.exp(-(x * x / (2 * radius_dev**2) + y * y / (2 * time_dev**2)))

    return f


def wavefront_source(plane, wave, amplitude):
    """Signed distance to a plane (nx, ny, nz, d), rippled by the sine of another."""
    return lambda r, t=0.0: dot(r, lits(plane[:3])) + plane[3] + F.sin(dot(r, lits(wave[:3])) + wave[3]) * amplitude


def blend(dst: Column, src: Column, scale_dst: float = 1.0, scale_src: float = 1.0) -> Column:
    return dst * scale_dst + src * scale_src
