"""Row-local updates of particles. With a region, rows outside keep their values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.domain import IDENTITY, Domain
from cellframe.functions.keys import uniform_key
from cellframe.functions.vec import AXES, add, lits, matvec, scaled, vec
from cellframe.operators.regions import Regions


def update(df: DataFrame, prefix: str, value, where: Column | None = None) -> DataFrame:
    """Sets a vector's three columns, where the condition holds."""
    return df.withColumns({f"{prefix}{a}": v if where is None else F.when(where, v).otherwise(F.col(f"{prefix}{a}")) for a, v in zip(AXES, value)})


def _where(regions: Regions | None, region: str | None) -> Column | None:
    """Tests the grid-space position, as these operators do."""
    return None if region is None else (regions or Regions()).predicate(region, vec("r"), F.col("id"))


def shift(df: DataFrame, prefix: str, value, regions: Regions | None = None, region: str | None = None) -> DataFrame:
    """r or v plus a constant vector."""
    return update(df, prefix, add(vec(prefix), lits(value)), _where(regions, region))


def scale(df: DataFrame, prefix: str, value, regions: Regions | None = None, region: str | None = None) -> DataFrame:
    """r or v times a vector, component by component; the value must be given."""
    return update(df, prefix, tuple(c * v for c, v in zip(vec(prefix), lits(value))), _where(regions, region))


def assign(df: DataFrame, prefix: str, value, regions: Regions | None = None, region: str | None = None) -> DataFrame:
    """v or f set to a constant vector."""
    return update(df, prefix, lits(value), _where(regions, region))


def zero_force(df: DataFrame) -> DataFrame:
    return assign(df, "f", (0.0, 0.0, 0.0))


def divide_force_by_type(df: DataFrame, types: DataFrame, prop: str, regions: Regions | None = None, region: str | None = None, max_types: int = 100_000) -> DataFrame:
    """f over a property of the particle's type.

    An unknown property raises; a type without a row, and a property of 0 or
    null, give a null force. The types table is broadcast only up to max_types rows.
    """
    if prop not in types.columns:
        raise KeyError(f"unknown type property {prop!r}")
    few = types.select("type").limit(max_types + 1).count() <= max_types
    table = types.groupBy("type").agg(F.first(prop).alias("__prop"))
    joined = df.join(F.broadcast(table) if few else table, "type", "left")
    p = F.when(F.col("__prop") != 0, F.col("__prop"))
    return update(joined, "f", tuple(c / p for c in vec("f")), _where(regions, region)).drop("__prop")


def transform_matrix(domain: Domain, mode: str):
    return {"IDENTITY": IDENTITY, "XFORM": domain.xform, "INV_XFORM": domain.inverse}[mode]


def push_first(df: DataFrame, dst: str, src: str, dt: float, dt_scale: float = 1.0, domain: Domain | None = None, mode: str = "IDENTITY") -> DataFrame:
    """dst += M src dt: push_v_r, push_f_v and push_f_r."""
    m = transform_matrix(domain or Domain(), mode)
    return update(df, dst, add(vec(dst), scaled(matvec(m, vec(src)), F.lit(float(dt * dt_scale)))))


def push_second(df: DataFrame, dt: float, dt_scale: float = 1.0, domain: Domain | None = None, mode: str = "INV_XFORM") -> DataFrame:
    """r += M (v d + f d^2 / 2) with d = dt * dt_scale."""
    d = float(dt * dt_scale)
    m = transform_matrix(domain or Domain(), mode)
    step = add(scaled(vec("v"), F.lit(d)), scaled(vec("f"), F.lit(d * d * 0.5)))
    return update(df, "r", add(vec("r"), matvec(m, step)))


def apply_xform(df: DataFrame, xform) -> DataFrame:
    return update(df, "r", matvec(xform, vec("r")))


def gaussian(id_: Column, seed: int) -> Column:
    """Standard normal number keyed by id and seed (Box-Muller over two keyed uniforms)."""
    u, w = uniform_key(id_, 2 * seed), uniform_key(id_, 2 * seed + 1)
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2.0 * math.pi * w)


def gaussian_noise(df: DataFrame, prefix: str, sigma: float, cut: float | None = None, seed: int = 0, where: Column | None = None) -> DataFrame:
    """Adds N(0, sigma) to each component, clamped to the cut; the same for an id in every run and layout."""
    noise = [gaussian(F.col("id"), 3 * seed + i) * sigma for i in range(3)]
    if cut is not None:
        noise = [F.greatest(F.least(n, F.lit(float(cut))), F.lit(-float(cut))) for n in noise]
    return update(df, prefix, add(vec(prefix), noise), where)


def uniform_noise(df: DataFrame, prefix: str, sigma: float, seed: int = 0, where: Column | None = None) -> DataFrame:
    """Adds U(-sigma, sigma) to each component, keyed by id."""
    noise = [(uniform_key(F.col("id"), 3 * seed + i) * 2.0 - 1.0) * float(sigma) for i in range(3)]
    return update(df, prefix, add(vec(prefix), noise), where)


def fluid_friction(df: DataFrame, coefficient: Column, velocity) -> DataFrame:
    """f += c (u - v) |u - v|; where c is null (no cell value) the force stays."""
    rel = tuple(u - v for u, v in zip(velocity, vec("v")))
    size = F.sqrt(rel[0] * rel[0] + rel[1] * rel[1] + rel[2] * rel[2])
    return update(df, "f", tuple(f + coefficient * x * size for f, x in zip(vec("f"), rel)), coefficient.isNotNull())


def quantised_backup(df: DataFrame, domain: Domain) -> DataFrame:
    """id and positions as 32-bit fractions of the cell: ci..ck and qx..qz. Lossy by a cell over 2**32."""
    out = {"id": F.col("id")}
    for i, a in enumerate(AXES):
        at = (F.col(f"r{a}") - domain.bmin[i]) / domain.cell_size
        out |= {("ci", "cj", "ck")[i]: F.floor(at).cast("int"), f"q{a}": F.least(F.floor((at - F.floor(at)) * F.lit(2.0**32)).cast("long"), F.lit(2**32 - 1))}
    return df.select(*(c.alias(n) for n, c in out.items()))


def backed_up(backup: DataFrame, domain: Domain) -> DataFrame:
    """id, rx, ry, rz from a quantised backup."""
    return backup.select("id", *((domain.bmin[i] + (F.col(c) + F.col(f"q{a}") / F.lit(2.0**32)) * domain.cell_size).alias(f"r{a}") for i, (a, c) in enumerate(zip(AXES, ("ci", "cj", "ck")))))


def restore(df: DataFrame, backup: DataFrame, backup_xform=IDENTITY, xform=IDENTITY) -> DataFrame:
    """Positions of a backup (id, rx, ry, rz) put back, from the space of the old deformation into that of the new.

    Particles without a backup keep their positions.
    """
    new = Domain(xform=tuple(xform)).inverse
    moved = matvec(new, matvec(backup_xform, vec("r")))
    old = backup.select("id", *(c.alias(f"__b{a}") for c, a in zip(moved, AXES)))
    joined = df.join(old, "id", "left")
    return joined.withColumns({f"r{a}": F.coalesce(F.col(f"__b{a}"), F.col(f"r{a}")) for a in AXES}).drop(*(f"__b{a}" for a in AXES)).select(*df.columns)


def move_particles(df: DataFrame, domain: Domain) -> tuple[DataFrame, DataFrame]:
    """Particles with wrapped positions and cells, and those outside the closed axes."""
    moved = domain.with_cells(domain.wrap(df))
    ok = F.coalesce(domain.inside(list(vec("r"))), F.lit(False))
    return moved.where(ok), moved.where(~ok)
