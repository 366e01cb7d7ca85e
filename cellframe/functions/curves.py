"""Curves fitted on the driver and evaluated as Columns: natural cubic splines, piecewise lines, polynomials."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Spline:
    """Natural cubic spline; outside the knots the end parabola goes on."""

    def __init__(self, x: Sequence[float], y: Sequence[float]):
        self.x, self.y = np.asarray(x, float), np.asarray(y, float)
        n, h = len(self.x), np.diff(self.x)
        if n < 2 or (h <= 0).any():
            raise ValueError("a spline needs two knots and more, in ascending order")
        a, r = np.eye(n), np.zeros(n)
        for i in range(1, n - 1):
            a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
            r[i] = 3 * ((self.y[i + 1] - self.y[i]) / h[i] - (self.y[i] - self.y[i - 1]) / h[i - 1])
        self.c = np.linalg.solve(a, r)
        self.b = np.diff(self.y) / h - h * (2 * self.c[:-1] + self.c[1:]) / 3
        self.d = np.diff(self.c) / (3 * h)

    def pieces(self) -> list[tuple[float, float, float, float, float]]:
        """(knot, y, b, c, d) from each knot on; the last has no cubic term."""
        h = self.x[-1] - self.x[-2]
        slope = self.b[-1] + 2 * self.c[-2] * h + 3 * self.d[-1] * h * h
        inner = [tuple(map(float, p)) for p in zip(self.x[:-1], self.y[:-1], self.b, self.c[:-1], self.d)]
        return [*inner, (float(self.x[-1]), float(self.y[-1]), float(slope), float(self.c[-1]), 0.0)]

    def __call__(self, t: float) -> float:
        p = self.pieces()
        if t < self.x[0]:
            k, y, b, c, _ = p[0]
            return y + b * (t - k) + c * (t - k) ** 2
        k, y, b, c, d = p[int(np.searchsorted(self.x, t, side="right")) - 1]
        u = t - k
        return y + u * (b + u * (c + u * d))

    def column(self, t: Column) -> Column:
        """As-of lookup of the interval in the literal knots, then the cubic."""
        p = self.pieces()
        i = F.greatest(F.size(F.filter(F.lit([q[0] for q in p]), lambda k: k <= t)), F.lit(1))
        k, y, b, c, d = (F.element_at(F.lit([q[j] for q in p]), i) for j in range(5))
        u = t - k
        return y + u * (b + u * (c + u * F.when(t < self.x[0].item(), F.lit(0.0)).otherwise(d)))


def piecewise_linear(x: Sequence[float], y: Sequence[float], t: float) -> float:
    """Linear between the knots, constant beyond them."""
    return float(np.interp(t, x, y))


def polynomial_fit(x: Sequence[float], y: Sequence[float], degree: int) -> list[float]:
    """Least-squares coefficients, lowest power first, from the sums of powers."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    return fit_from_sums([float((x**k).sum()) for k in range(2 * degree + 1)], [float((y * x**k).sum()) for k in range(degree + 1)])


def fit_from_sums(powers: Sequence[float], moments: Sequence[float]) -> list[float]:
    """Coefficients from sum(x^k) and sum(y x^k), which one distributed aggregate gives."""
    n = len(moments)
    a = np.array([[powers[i + j] for j in range(n)] for i in range(n)])
    return np.linalg.lstsq(a, np.asarray(moments), rcond=None)[0].tolist()
