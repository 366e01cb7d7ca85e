"""Values on sub-cells: the relation V(ci, cj, ck, si, sj, sk, fields...)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.domain import AXES, Domain
from cellframe.functions.vec import matvec
from cellframe.operators.regions import Regions

CELL = ["ci", "cj", "ck"]
SUB = ["si", "sj", "sk"]
KEY = [*CELL, *SUB]


def all_sub_cells(spark: SparkSession, domain: Domain, subdiv: int = 1) -> DataFrame:
    """Every sub-cell of the grid, made on the executors from a range."""
    nx, ny, nz = (d * subdiv for d in domain.grid_dims)
    g = spark.range(nx * ny * nz)
    x, y, z = F.col("id") % nx, F.floor(F.col("id") / nx) % ny, F.floor(F.col("id") / (nx * ny))
    out = {}
    for c, s, k in zip(CELL, SUB, (x, y, z)):
        out |= {c: F.floor(k / subdiv).cast("int"), s: (k % subdiv).cast("int")}
    return g.select(*(out[k].alias(k) for k in KEY))


def centre(domain: Domain, subdiv: int, lab: bool = True) -> tuple[Column, Column, Column]:
    size = domain.cell_size / subdiv
    r = tuple(domain.bmin[i] + F.col(c) * domain.cell_size + (F.col(s) + 0.5) * size for i, (c, s) in enumerate(zip(CELL, SUB)))
    return matvec(domain.xform, r) if lab else r


def set_cell_values(cells: DataFrame, domain: Domain, subdiv: int, name: str, value, regions: Regions | None = None, region: str | None = None) -> DataFrame:
    """Sets a field to the value where the sub-cell's centre (lab space) is in the region; a new field is 0 elsewhere.

    A value of several components makes fields <name>_0, <name>_1 and so on.
    """
    inside = (regions or Regions()).predicate(region, centre(domain, subdiv))
    values = list(value) if isinstance(value, (list, tuple)) else [value]
    names = [name] if len(values) == 1 else [f"{name}_{i}" for i in range(len(values))]
    return cells.withColumns({n: F.when(inside, F.lit(float(v))).otherwise(F.col(n) if n in cells.columns else F.lit(0.0)) for n, v in zip(names, values)})


def locate(df: DataFrame, domain: Domain, subdiv: int) -> DataFrame:
    """Adds the sub-cell of each particle, on wrapped positions."""
    size = domain.cell_size / subdiv
    out = {}
    for i, (a, c, s) in enumerate(zip(AXES, CELL, SUB)):
        r = domain.wrapped(i, F.col(f"r{a}")) - domain.bmin[i]
        cell = F.floor(r / domain.cell_size)
        sub = F.floor((r - cell * domain.cell_size) / size)
        out |= {c: cell.cast("int"), s: F.greatest(F.least(sub, F.lit(subdiv - 1)), F.lit(0)).cast("int")}
    return df.withColumns(out)


def lookup(df: DataFrame, cells: DataFrame, domain: Domain, subdiv: int, names: list[str]) -> DataFrame:
    """Particles with the values of their sub-cell; null where there is none."""
    return locate(df, domain, subdiv).join(cells.select(*KEY, *names), KEY, "left").drop(*KEY)


def project(df: DataFrame, domain: Domain, splat: float, subdiv: int, values: dict[str, Column]) -> DataFrame:
    """Splats particle values on sub-cells: V with the weighted sums; sub-cells nothing reaches have no row.

    A particle is a box of side `splat`; the weight of a sub-cell is the share of
    the box in it. Contributions wrap on periodic axes and are dropped beyond
    closed ones. Null positions and values contribute nothing; the weights of a
    particle sum to 1 whatever the box's size.
    """
    size = domain.cell_size / subdiv
    n = [d * subdiv for d in domain.grid_dims]
    spread = math.ceil(splat / size / 2 + 0.5)
    p = df.select(*(domain.wrapped(i, F.col(f"r{a}")).alias(f"r{a}") for i, a in enumerate(AXES)), *(v.cast("double").alias(k) for k, v in values.items()))
    p = p.where(F.col("rx").isNotNull() & F.col("ry").isNotNull() & F.col("rz").isNotNull())
    for i, a in enumerate(AXES):
        r = F.col(f"r{a}") - domain.bmin[i]
        home = F.floor(r / size).cast("long")
        entries = []
        for o in range(-spread, spread + 1):
            k = home + o
            overlap = F.least(r + splat / 2, (k + 1) * size) - F.greatest(r - splat / 2, k * size)
            at = F.pmod(k, F.lit(n[i]).cast("long")) if domain.periodic[i] else k
            ok = (overlap > 0) if domain.periodic[i] else (overlap > 0) & (k >= 0) & (k < n[i])
            entries.append(F.when(ok, F.struct(at.cast("int").alias("k"), (overlap / splat).alias("w"))))
        p = p.withColumn(f"__{a}", F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())))
    w = F.col("__x.w") * F.col("__y.w") * F.col("__z.w")
    sums = p.groupBy(*(F.col(f"__{a}.k").alias(f"k{a}") for a in AXES)).agg(*(F.sum(w * F.col(k)).alias(k) for k in values))
    keys = {}
    for a, c, s in zip(AXES, CELL, SUB):
        keys |= {c: F.floor(F.col(f"k{a}") / subdiv).cast("int"), s: (F.col(f"k{a}") % subdiv).cast("int")}
    return sums.select(*(keys[k].alias(k) for k in KEY), *values)


def cell_images(cells: DataFrame, domain: Domain, layers: int) -> DataFrame:
    """Copies of the cells within `layers` of a periodic face, at the indices beyond the opposite face."""
    out = cells.withColumn("__image", F.lit(False))
    for i, c in enumerate(CELL):
        if domain.periodic[i]:
            n = domain.grid_dims[i]
            shifts = [F.when((F.col(c) + o >= -layers) & (F.col(c) + o < n + layers), F.lit(o)) for o in (-n, 0, n)]
            out = out.withColumn("__o", F.explode(F.filter(F.array(*shifts), lambda o: o.isNotNull())))
            out = out.withColumns({c: (F.col(c) + F.col("__o")).cast("int"), "__image": F.col("__image") | (F.col("__o") != 0)}).drop("__o")
    return out.where("__image").drop("__image")


def wrap_cells(cells: DataFrame, domain: Domain) -> DataFrame:
    """Cells beyond periodic faces at the indices that they are images of."""
    return cells.withColumns({c: F.pmod(F.col(c), F.lit(domain.grid_dims[i])).cast("int") for i, c in enumerate(CELL) if domain.periodic[i]}) if any(domain.periodic) else cells


def add_cell_values(*parts: DataFrame) -> DataFrame:
    """Cell values of several sources or owners added up by sub-cell."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    names = [c for c in every.columns if c not in KEY]
    return every.groupBy(*KEY).agg(*(F.sum(n).alias(n) for n in names))
