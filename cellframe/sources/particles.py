"""Sources of particles: driver tables, literal lists, lattices, replicas, and the types table."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellframe.domain import AXES, Domain
from cellframe.functions.vec import matvec, vec
from cellframe.operators.ranking import dense_number, next_id
from cellframe.operators.regions import Regions, located

COLUMNS = ["id", "type", *(f"{p}{a}" for p in "rvf" for a in AXES)]
SCHEMA = "id long, type int, " + ", ".join(f"{p}{a} double" for p in "rvf" for a in AXES)

# Positions of the atoms in the unit cells, in cell lengths.
STRUCTURES = {
    "SC": [(0.5, 0.5, 0.5)],
    "BCC": [(0.0, 0.0, 0.0), (0.5, 0.5, 0.5)],
    "2BCT": [(0.0, 0.0, 0.0), (0.0, 0.5, 0.25), (0.5, 0.5, 0.5), (0.5, 0.0, 0.75)],
    "FCC": [(0.0, 0.0, 0.0), (0.0, 0.5, 0.5), (0.5, 0.0, 0.5), (0.5, 0.5, 0.0)],
    "HCP": [(0.25, 0.25, 0.25), (0.75, 0.75, 0.25), (0.25, 0.58333333, 0.75), (0.75, 0.08333333, 0.75)],
    "c-DIA": [(0.0, 0.0, 0.0), (0.5, 0.5, 0.0), (0.0, 0.5, 0.5), (0.5, 0.0, 0.5), (0.25, 0.25, 0.25), (0.75, 0.75, 0.25), (0.75, 0.25, 0.75), (0.25, 0.75, 0.75)],
    "h-DIA": [(0.5, 0.16666667, 0.5), (0.0, 0.66666667, 0.5), (0.5, 0.16666667, 0.875), (0.0, 0.66666667, 0.875), (0.0, 0.33333333, 0.0), (0.5, 0.83333333, 0.0), (0.0, 0.33333333, 0.375), (0.5, 0.83333333, 0.375)],
    "graphite": [(0.0, 0.0, 0.5), (0.5, 0.5, 0.5), (0.5, 0.16666667, 0.5), (0.0, 0.66666667, 0.5), (0.0, 0.33333333, 0.0), (0.5, 0.83333333, 0.0), (0.0, 0.0, 0.0), (0.5, 0.5, 0.0)],
}
HEXAGONAL = ("HCP", "h-DIA", "graphite")


def from_embeddings(df: DataFrame) -> DataFrame:
    """Particles of embeddings: the first three components shifted by a half are r, the next v, the next f."""
    at = lambda i: F.col("embedding")[i].cast("double")
    return df.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("int").alias("type"), *((at(i) + 0.5).alias(f"r{a}") for i, a in enumerate(AXES)), *(at(3 + i).alias(f"v{a}") for i, a in enumerate(AXES)), *(at(6 + i).alias(f"f{a}") for i, a in enumerate(AXES)))


def from_events(df: DataFrame) -> DataFrame:
    """Particles of events: days since 2024, user and value are r; type is the number of the event type by name."""
    kinds = df.select("event_type").distinct()
    kinds = kinds.select("event_type", F.row_number().over(Window.orderBy("event_type")).alias("type"))  # a few event types
    days = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / F.lit(86_400_000_000.0)
    out = df.join(F.broadcast(kinds), "event_type", "left")
    zero = F.lit(0.0)
    return out.select(F.col("event_id").cast("long").alias("id"), (F.col("type") - 1).cast("int").alias("type"), days.alias("rx"), (F.col("user_id") % 30).cast("double").alias("ry"), (F.col("value") / 20).alias("rz"), F.col("value").alias("vx"), zero.alias("vy"), zero.alias("vz"), zero.alias("fx"), zero.alias("fy"), zero.alias("fz"))


def from_lineitem(df: DataFrame) -> DataFrame:
    """Particles of lineitem: quantity, price and discount are r; ids number the rows in the order of all columns."""
    numbered = dense_number(df, [*df.columns], "id")
    code = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return numbered.select("id", code.cast("int").alias("type"), F.col("l_quantity").alias("rx"), (F.col("l_extendedprice") / 2100).alias("ry"), (F.col("l_discount") * 500).alias("rz"), F.col("l_tax").alias("vx"), F.col("l_discount").alias("vy"), F.lit(0.0).alias("vz"), F.lit(0.0).alias("fx"), F.lit(0.0).alias("fy"), F.lit(0.0).alias("fz"))


def insert(df: DataFrame, domain: Domain, particles: Sequence[dict], type_ids: dict[str, int] | None = None) -> DataFrame:
    """Adds a literal list of {pos, vel, type}: pos in lab space, type a name or a number; ids go on from the greatest.

    Rows outside the domain are dropped before ids are given.
    """
    inv = np.array(domain.inverse).reshape(3, 3)
    rows, start = [], next_id(df)
    for p in particles:
        r = inv @ np.asarray(p["pos"], float)
        if all(lo <= x < hi for lo, x, hi in zip(domain.bmin, r, domain.bmax)):
            t = p.get("type", 0)
            kind = type_ids[t] if type_ids and t in type_ids else int(t)
            rows.append((start + len(rows), kind, *map(float, r), *map(float, p.get("vel", (0, 0, 0))), 0.0, 0.0, 0.0))
    new = df.sparkSession.createDataFrame(rows, SCHEMA)
    return df.unionByName(new, allowMissingColumns=True)


def lattice(spark: SparkSession, domain: Domain, structure: str, types: Sequence[int], size: Sequence[float], positions=None, shift=(0.0, 0.0, 0.0), regions: Regions | None = None, region: str | None = None, source=None, threshold: float = 0.0, voids: Sequence[tuple[Sequence[float], float]] = (), start_id: int = 0) -> DataFrame:
    """Fills the domain with a repeated unit cell; made on the executors from a range.

    An atom is kept if its grid position lies in the domain and its cell in the
    grid, the region and source function accept its lab position, and no void
    sphere (centre, radius) holds it. ids go on from start_id in the order of
    cells (z, y, x), then of the lattice.
    """
    if structure == "CUSTOM":
        atoms = [tuple(map(float, p)) for p in positions or ()]
        if not atoms:
            raise ValueError("a CUSTOM structure needs positions")
    else:
        atoms = STRUCTURES[structure]
    if len(types) != len(atoms):
        raise ValueError(f"{structure} needs {len(atoms)} types")
    if any(not 0.0 <= c <= 1.0 for p in atoms for c in p):
        raise ValueError("positions must lie in the unit cell")
    size = [float(s) for s in size]
    if structure in HEXAGONAL:
        size[1] *= 2.0 * math.sin(math.radians(120.0))
    corners = [domain.matrix @ np.array(c) for c in np.ndindex(2, 2, 2) for c in [[(domain.bmin, domain.bmax)[k][i] for i, k in enumerate(c)]]]
    lo = [math.floor(min(c[i] for c in corners) / size[i]) - 1 for i in range(3)]
    hi = [math.ceil(max(c[i] for c in corners) / size[i]) + 1 for i in range(3)]
    n = [h - low + 1 for low, h in zip(lo, hi)]
    m = len(atoms)
    g = spark.range(n[0] * n[1] * n[2] * m)
    l = F.col("id") % m
    cell = F.floor(F.col("id") / m)
    step = [cell % n[0] + lo[0], F.floor(cell / n[0]) % n[1] + lo[1], F.floor(cell / (n[0] * n[1])) + lo[2]]
    atom = [F.element_at(F.lit([float(p[i]) for p in atoms]), (l + 1).cast("int")) for i in range(3)]
    lab = [(step[i] + atom[i]) * size[i] + float(shift[i]) for i in range(3)]
    kind = F.element_at(F.lit([int(t) for t in types]), (l + 1).cast("int"))
    p = g.select(F.col("id").alias("__at"), kind.alias("type"), *(c.alias(f"__l{a}") for c, a in zip(lab, AXES)))
    where = vec("__l")
    p = p.withColumns({f"r{a}": c for a, c in zip(AXES, matvec(domain.inverse, where))})
    cells = {f"__c{a}": F.floor((F.col(f"r{a}") - domain.bmin[i]) / domain.cell_size) for i, a in enumerate(AXES)}
    p = p.withColumns(cells)
    keep = F.lit(True)
    for i, a in enumerate(AXES):
        keep = keep & (F.col(f"r{a}") >= domain.bmin[i]) & (F.col(f"r{a}") <= domain.bmax[i]) & (F.col(f"__c{a}") >= 0) & (F.col(f"__c{a}") < domain.grid_dims[i])
    keep = keep & located(regions, region, where, None, source=source, threshold=threshold)
    for c, radius in voids:
        d = [x - float(v) for x, v in zip(where, c)]
        keep = keep & (d[0] * d[0] + d[1] * d[1] + d[2] * d[2] > float(radius) ** 2)
    made = dense_number(p.where(keep), ["__cz", "__cy", "__cx", "__at"], "id").withColumn("id", F.col("id") + start_id)
    return made.select("id", "type", "rx", "ry", "rz", *(F.lit(0.0).alias(f"{q}{a}") for q in "vf" for a in AXES))


def porosity_voids(domain: Domain, porosity: float, mean_diameter: float, seed: int = 0) -> list[tuple[tuple[float, ...], float]]:
    """Void spheres drawn until their volume is the wanted share of the domain; one draw of the radius each."""
    rng, voids, volume = np.random.default_rng(seed), [], 0.0
    while volume / domain.volume() < porosity:
        radius = abs(rng.normal(1.0, 0.5)) * mean_diameter
        voids.append((tuple(rng.uniform(domain.bmin, domain.bmax)), float(radius)))
        volume += 4.0 * math.pi * radius**3 / 3.0
    return voids


def replicate(df: DataFrame, domain: Domain, repeat: Sequence[int]) -> tuple[DataFrame, Domain]:
    """The domain repeated nx x ny x nz times: shifted positions, ids moved by whole blocks, bounds and cells multiplied."""
    nx, ny, nz = repeat
    block = next_id(df)
    copy = df.withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit(nx * ny * nz - 1))))
    c = F.col("__c")
    at = (c % nx, F.floor(c / nx) % ny, F.floor(c / (nx * ny)))
    out = copy.withColumns({"id": F.col("id") + c * block, **{f"r{a}": F.col(f"r{a}") + at[i] * domain.size[i] for i, a in enumerate(AXES)}}).drop("__c")
    bmax = tuple(lo + s * k for lo, s, k in zip(domain.bmin, domain.size, repeat))
    return out, domain.override(bmax=bmax, grid_dims=tuple(d * k for d, k in zip(domain.grid_dims, repeat)))


def particle_types(spark: SparkSession, types: dict[str, dict]) -> DataFrame:
    """T(type, name, properties...): types are numbered in the order given."""
    names = sorted({k for p in types.values() for k in p})
    rows = [(i, n, *(float(p[k]) if k in p else None for k in names)) for i, (n, p) in enumerate(types.items())]
    return spark.createDataFrame(rows, "type int, name string" + "".join(f", `{k}` double" for k in names))


def add_type_properties(types: DataFrame, properties: dict[str, dict]) -> DataFrame:
    """Properties added to known types by name; an unknown name raises."""
    known = {r.name for r in types.select("name").collect()}
    if unknown := set(properties) - known:
        raise KeyError(f"unknown types {sorted(unknown)}")
    for k in sorted({k for p in properties.values() for k in p}):
        value: Column = F.col(k) if k in types.columns else F.lit(None).cast("double")
        for name, p in properties.items():
            if k in p:
                value = F.when(F.col("name") == name, F.lit(float(p[k]))).otherwise(value)
        types = types.withColumn(k, value)
    return types
