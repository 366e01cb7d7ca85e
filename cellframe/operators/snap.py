"""The spectral neighbour analysis potential: bispectrum components of the neighbour density, energies and forces.

Directions and distances of neighbours map to rotations of the 3-sphere. The
density's coefficients are sums of their representation matrices; a bispectrum
component couples three of them by Clebsch-Gordan coefficients, so it doesn't
change when the neighbourhood turns. Energies are linear in the components, and
forces follow by the chain rule through the coefficients. Neighbours are listed
by the distance join; the kernel runs on Arrow batches, all atoms of a chunk together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.domain import AXES, Domain
from cellframe.operators.neighbors import neighbors


@dataclass(frozen=True)
class Snap:
    """Parameters: doubled angular momentum, cutoffs, and per type radius, weight and coefficients (the constant first)."""

    twojmax: int
    rcutfac: float
    radius: tuple[float, ...]
    weight: tuple[float, ...]
    coefficients: tuple[tuple[float, ...], ...]
    rfac0: float = 0.99363
    rmin0: float = 0.0
    bzero: bool = True

    @property
    def rcut(self) -> float:
        return 2 * max(self.radius) * self.rcutfac


def parse(parameters: str, coefficients: str) -> Snap:
    """From the texts of a parameter file (name value) and a coefficient file (counts, then name, radius, weight and values)."""
    lines = lambda t: [x.split("#")[0].split() for x in t.splitlines() if x.split("#")[0].split()]
    p = {x[0]: x[1] for x in lines(parameters)}
    head, *rest = lines(coefficients)
    elements, count = int(head[0]), int(head[1])
    radius, weight, values = [], [], []
    for i in range(elements):
        name, *block = rest[i * (count + 1) : (i + 1) * (count + 1)]
        radius.append(float(name[1]))
        weight.append(float(name[2]))
        values.append(tuple(float(v[0]) for v in block))
    if p.get("quadraticflag", "0") != "0":
        raise ValueError("quadratic potentials aren't known")
    return Snap(int(p["twojmax"]), float(p["rcutfac"]), tuple(radius), tuple(weight), tuple(values), float(p.get("rfac0", 0.99363)), float(p.get("rmin0", 0.0)), p.get("bzeroflag", "1") != "0")


def triples(twojmax: int) -> list[tuple[int, int, int]]:
    """The couplings (j1, j2, j), doubled, with j >= j1 >= j2, in the order of the coefficients."""
    return [(j1, j2, j) for j1 in range(twojmax + 1) for j2 in range(j1 + 1) for j in range(j1 - j2, min(twojmax, j1 + j2) + 1, 2) if j >= j1]


@lru_cache(maxsize=None)
def coupling(j1: int, j2: int, j: int) -> np.ndarray:
    """Clebsch-Gordan coefficients of doubled momenta as a matrix (m of j) x (m1 of j1) x (m2 of j2)."""
    f = lambda n: math.factorial(n // 2)
    out = np.zeros((j + 1, j1 + 1, j2 + 1))
    norm = (j + 1) * f(j + j1 - j2) * f(j - j1 + j2) * f(j1 + j2 - j) / f(j1 + j2 + j + 2)
    for a in range(j1 + 1):
        for b in range(j2 + 1):
            m1, m2 = 2 * a - j1, 2 * b - j2
            m = m1 + m2
            if abs(m) > j:
                continue
            size = f(j + m) * f(j - m) * f(j1 - m1) * f(j1 + m1) * f(j2 - m2) * f(j2 + m2)
            total = 0.0
            for k in range(0, (j1 + j2 - j) // 2 + 1):
                parts = [2 * k, j1 + j2 - j - 2 * k, j1 - m1 - 2 * k, j2 + m2 - 2 * k, j - j2 + m1 + 2 * k, j - j1 - m2 + 2 * k]
                if min(parts) >= 0:
                    total += (-1) ** k / math.prod(map(f, parts))
            out[(m + j) // 2, a, b] = math.sqrt(norm * size) * total
    return out


def representations(d: np.ndarray, rcut: np.ndarray, p: Snap) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For separations d (n x 3): cut-off representation matrices of every j, and their derivatives (n x 3 x ...)."""
    r = np.sqrt((d * d).sum(1))
    unit = d / r[:, None]
    scale = p.rfac0 * math.pi / (rcut - p.rmin0)
    theta = (r - p.rmin0) * scale
    z0 = r / np.tan(theta)
    dz0 = z0 / r - r * scale / np.sin(theta) ** 2
    four = np.stack([d[:, 0], d[:, 1], d[:, 2], z0], 1)
    dfour = np.zeros((len(d), 3, 4))
    dfour[:, [0, 1, 2], [0, 1, 2]] = 1.0
    dfour[:, :, 3] = dz0[:, None] * unit
    r0 = np.sqrt((four * four).sum(1))
    dr0 = np.einsum("nk,nck->nc", four, dfour) / r0[:, None]
    q = four / r0[:, None]
    dq = dfour / r0[:, None, None] - q[:, None, :] * (dr0 / r0[:, None])[:, :, None]
    matrix = lambda v: np.stack([np.stack([v[..., 3] - 1j * v[..., 2], v[..., 1] - 1j * v[..., 0]], -1), np.stack([-v[..., 1] - 1j * v[..., 0], v[..., 3] + 1j * v[..., 2]], -1)], -2)
    one, done = matrix(q), matrix(dq)
    us, dus = [np.ones((len(d), 1, 1), complex)], [np.zeros((len(d), 3, 1, 1), complex)]
    for j in range(1, p.twojmax + 1):
        c = coupling(j - 1, 1, j).reshape(j + 1, -1)
        kron = lambda x, y: np.einsum("...ac,...bd->...abcd", x, y).reshape(*np.broadcast_shapes(x.shape[:-2], y.shape[:-2]), c.shape[1], c.shape[1])  # noqa: B023, E731
        dus.append(c @ (kron(dus[-1], one[:, None]) + kron(us[-1][:, None], done)) @ c.T)
        us.append(c @ kron(us[-1], one) @ c.T)
    x = math.pi * (r - p.rmin0) / (rcut - p.rmin0)
    inside = r <= rcut
    cut = np.where(inside, 0.5 * (np.cos(x) + 1.0), 0.0)
    dcut = np.where(inside, -0.5 * np.sin(x) * math.pi / (rcut - p.rmin0), 0.0)[:, None] * unit
    out = [cut[:, None, None] * u for u in us]
    return out, [cut[:, None, None, None] * du + dcut[:, :, None, None] * u[:, None] for u, du in zip(us, dus)]


#: Neighbours whose derivatives are held at a time: some 20 MB for each momentum of the published potentials.
CHUNK = 4096


def atoms(d: np.ndarray, kinds: np.ndarray, counts: np.ndarray, own: np.ndarray, p: Snap) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For atoms of kinds `own` with counts[i] neighbours each (d, kinds: one after the other): energies, bispectra, and the derivative of an atom's energy by each neighbour's position."""
    radius, weight, beta = np.array(p.radius), np.array(p.weight), np.array(p.coefficients)[own]
    at = np.repeat(np.arange(len(own)), counts)
    total = [np.repeat(np.eye(j + 1, dtype=complex)[None], len(own), 0) for j in range(p.twojmax + 1)]
    us, dus = representations(d, p.rcutfac * (radius[own][at] + radius[kinds]), p) if len(d) else ([], [])
    w = weight[kinds]
    for t, u in zip(total, us):
        np.add.at(t, at, w[:, None, None] * u)
    energy, parts, slope = beta[:, 0].copy(), [], [np.zeros((len(own), j + 1, j + 1), complex) for j in range(p.twojmax + 1)]
    for k, (j1, j2, j) in enumerate(triples(p.twojmax)):
        c = coupling(j1, j2, j).reshape(j + 1, -1)
        both = np.einsum("nac,nbd->nabcd", total[j1], total[j2]).reshape(len(own), c.shape[1], c.shape[1])
        z = c @ both @ c.T
        parts.append((total[j].conj() * z).sum((1, 2)).real - ((j + 1) if p.bzero else 0.0))
        b = beta[:, k + 1]
        energy += b * parts[-1]
        back = (c.T @ total[j].conj() @ c).reshape(len(own), j1 + 1, j2 + 1, j1 + 1, j2 + 1)
        slope[j] += b[:, None, None] * z.conj()
        slope[j1] += b[:, None, None] * np.einsum("nabcd,nbd->nac", back, total[j2])
        slope[j2] += b[:, None, None] * np.einsum("nabcd,nac->nbd", back, total[j1])
    force = np.zeros((len(d), 3))
    for s, du in zip(slope, dus):
        force += w[:, None] * np.einsum("nab,nxab->nx", s[at], du).real
    return energy, np.array(parts).T, force


def atom(d: np.ndarray, kinds: np.ndarray, kind: int, p: Snap) -> tuple[float, np.ndarray, np.ndarray]:
    """Energy of one atom, its bispectrum, and the derivative of the energy by each neighbour's position (n x 3)."""
    energy, parts, force = atoms(d, kinds, np.array([len(d)]), np.array([kind]), p)
    return float(energy[0]), parts[0], force


def _kernel(p: Snap):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            lists = {c: [np.asarray(v) if v is not None else np.zeros(0) for v in f[c]] for c in ("b", "dx", "dy", "dz", "kinds")}
            counts = np.array([len(v) for v in lists["b"]], np.int64)
            cut = np.flatnonzero(np.diff(np.cumsum(counts) // CHUNK)) + 1
            for rows in np.split(np.arange(len(f)), cut):
                if not len(rows):
                    continue
                flat = {c: np.concatenate([v[i] for i in rows]) for c, v in lists.items()}
                n, a = counts[rows], f["a"].to_numpy(np.int64)[rows]
                d = np.stack([flat[c] for c in ("dx", "dy", "dz")], 1).astype(float)
                energy, _, slope = atoms(d, flat["kinds"].astype(int), n, f["kind"].to_numpy(int)[rows], p)
                sums = np.zeros((len(rows), 3))
                np.add.at(sums, np.repeat(np.arange(len(rows)), n), slope)
                out = np.r_[np.c_[energy, sums], np.c_[np.zeros(len(d)), -slope]]
                yield pd.DataFrame({"id": np.r_[a, flat["b"].astype(np.int64)], "ep": out[:, 0], "sx": out[:, 1], "sy": out[:, 2], "sz": out[:, 3]})

    return run


def snap_force(df: DataFrame, domain: Domain, p: Snap) -> DataFrame:
    """Adds the potential's forces to fx, fy, fz, and `ep`, each particle's energy.

    `type` numbers the potential's elements; ids must be distinct. A particle
    without neighbours has the energy of an empty neighbourhood and no force. Each
    pair acts on both ends, so forces sum to 0.
    """
    typed = df.withColumn("__kind", F.col("type"))
    pairs = neighbors(typed, domain, p.rcut, keep=("__kind",))
    lists = pairs.groupBy("a").agg(F.collect_list(F.struct("b", "dx", "dy", "dz", F.col("nb___kind").alias("kind"))).alias("others"))
    every = df.where(F.col("id").isNotNull() & F.col("type").isNotNull()).select(F.col("id").alias("a"), F.col("type").alias("kind")).join(lists, "a", "left")
    parts = every.select("a", "kind", *(F.col(f"others.{c}").alias(c) for c in ("b", "dx", "dy", "dz")), F.col("others.kind").alias("kinds")).mapInPandas(_kernel(p), "id long, ep double, sx double, sy double, sz double")
    sums = parts.groupBy("id").agg(*(F.sum(c).alias(f"__{c}") for c in ("ep", "sx", "sy", "sz")))
    joined = df.drop("ep").join(sums, "id", "left")
    return joined.withColumns({f"f{a}": F.col(f"f{a}") + F.coalesce(F.col(f"__s{a}"), F.lit(0.0)) for a in AXES} | {"ep": F.coalesce("__ep", F.lit(0.0))}).drop("__ep", "__sx", "__sy", "__sz")
