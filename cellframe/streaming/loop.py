"""The step loop: second-order pushes around a force, with neighbour lists that a skin keeps valid.

Every step writes the particles to the shared folder, so that the lineage stays
short and a lost executor costs one step.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cellframe.domain import AXES, Domain
from cellframe.functions.vec import matvec, norm2
from cellframe.operators.neighbors import neighbors
from cellframe.operators.transform import push_first, push_second, zero_force
from cellframe.runtime import Scratch


@dataclass(frozen=True)
class Verlet:
    dt: float
    rcut: float
    skin: float
    force: Callable[[DataFrame, DataFrame], DataFrame]


def refreshed(pairs: DataFrame, df: DataFrame, domain: Domain, rcut: float) -> DataFrame:
    """Pairs of an older list with the separations of now, within rcut.

    The list holds the image shifts (ox, oy, oz) against unwrapped positions.
    """
    a = df.select(F.col("id").alias("a"), *(F.col(f"r{x}").alias(f"a{x}") for x in AXES))
    b = df.select(F.col("id").alias("b"), *(F.col(f"r{x}").alias(f"b{x}") for x in AXES))
    d = matvec(domain.xform, tuple(F.col(f"b{x}") - F.col(f"a{x}") + F.col(f"o{x}") for x in AXES))
    now = pairs.join(a, "a").join(b, "b").select("a", "b", *(c.alias(f"d{x}") for c, x in zip(d, AXES)))
    return now.withColumn("d2", norm2(tuple(F.col(f"d{x}") for x in AXES))).where((F.col("d2") > 0) & (F.col("d2") <= rcut * rcut))


def with_shifts(df: DataFrame, domain: Domain, reach: float) -> DataFrame:
    """Neighbour pairs with the image shift of each, for positions that are not wrapped until the next list."""
    pairs = neighbors(df, domain.override(xform=(1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)), reach)
    a = df.select(F.col("id").alias("a"), *(F.col(f"r{x}").alias(f"a{x}") for x in AXES))
    b = df.select(F.col("id").alias("b"), *(F.col(f"r{x}").alias(f"b{x}") for x in AXES))
    full = pairs.join(a, "a").join(b, "b")
    shift = {x: F.round((F.col(f"d{x}") - (F.col(f"b{x}") - F.col(f"a{x}"))) / domain.size[i]) * domain.size[i] for i, x in enumerate(AXES)}
    return full.select("a", "b", *(s.alias(f"o{x}") for x, s in shift.items()))


def run(df: DataFrame, domain: Domain, config: Verlet, steps: int) -> DataFrame:
    """The particles after a number of steps; lists are built anew when a particle moved by more than half the skin.

    A step is one job: it moves, takes the forces from the list at hand, writes,
    and tells by the way how far a particle has gone from where the list was
    built. If that is too far the step is taken again with a new list.
    """
    scratch = Scratch(df.sparkSession, "loop")
    reach = (config.rcut + config.skin) / domain.scales[0]
    marks = {f"__m{a}": F.col(f"r{a}") for a in AXES}

    def listed(p: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
        p = scratch.save(domain.wrap(p).withColumns(marks), f"wrapped{n}")
        return p, scratch.save(with_shifts(p.drop(*marks), domain, reach), f"pairs{n}")

    def moved(p: DataFrame) -> DataFrame:
        return push_first(push_second(p, config.dt, domain=domain), "v", "f", config.dt, 0.5)

    def finished(p: DataFrame, pairs: DataFrame) -> DataFrame:
        return push_first(config.force(zero_force(p), refreshed(pairs, p, domain, config.rcut)), "v", "f", config.dt, 0.5)

    lists = 0
    p, pairs = listed(df, lists)
    for step in range(1, steps + 1):
        gone = norm2(matvec(domain.xform, tuple(F.col(f"r{a}") - F.col(f"__m{a}") for a in AXES)))
        far = Observation(f"far{step}")
        now = scratch.save(finished(moved(p), pairs).observe(far, F.max(gone).alias("far2")), f"step{step}")
        if (far.get["far2"] or 0.0) > (config.skin / 2) ** 2:
            lists += 1
            fresh, pairs = listed(moved(p), lists)
            now = scratch.save(finished(fresh, pairs), f"step{step}")
            scratch.drop(f"pairs{lists - 1}")
        p = now
        if step > 1:
            scratch.drop(f"step{step - 1}")
    return domain.wrap(p.drop(*marks))
