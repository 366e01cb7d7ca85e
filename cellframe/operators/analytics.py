"""Aggregates over particles: statistics, histograms, slices, cell counts, costs."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.domain import AXES, Domain
from cellframe.functions.curves import fit_from_sums
from cellframe.functions.vec import dot, lits, matvec, norm, norm2, sub, vec

DBL_MAX = 1.7976931348623157e308


def simulation_stats(df: DataFrame) -> DataFrame:
    """n, sum of v.v (no mass, no half), least and greatest |v| and |f|. An empty table has minima of DBL_MAX, maxima of 0."""
    v, f = norm(vec("v")), norm(vec("f"))
    low = lambda c, n: F.coalesce(F.min(c), F.lit(DBL_MAX)).alias(n)
    top = lambda c, n: F.greatest(F.coalesce(F.max(c), F.lit(0.0)), F.lit(0.0)).alias(n)
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(norm2(vec("v"))), F.lit(0.0)).alias("sum_v2"), low(v, "min_vel"), top(v, "max_vel"), low(f, "min_acc"), top(f, "max_acc"))


def total_force(df: DataFrame) -> DataFrame:
    """Sum of f, its norm, and the sum of the norms."""
    sums = df.agg(*(F.coalesce(F.sum(f"f{a}"), F.lit(0.0)).alias(f"f{a}") for a in AXES), F.coalesce(F.sum(norm(vec("f"))), F.lit(0.0)).alias("sum_norm"))
    return sums.select(*(f"f{a}" for a in AXES), norm(vec("f")).alias("norm_sum"), "sum_norm")


def histogram(df: DataFrame, fields: list[str], samples: int = 1024) -> DataFrame:
    """plot, bin, x (centre), y (count) of equal bins between the least and the greatest value, empty bins kept.

    The greatest value falls in the last bin; with one distinct value all rows are
    in bin 0. Nulls, NaN and infinite values don't count; a field without values
    has no bins. All fields are counted in two passes together.
    """
    long = df.select(F.inline(F.array(*(F.struct(F.lit(f).alias("plot"), F.col(f).cast("double").alias("v")) for f in fields))))
    long = long.where(F.abs(F.col("v")) < float("inf"))
    ends = long.groupBy("plot").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / samples
    bins = F.least(F.floor(F.lit(samples) * (F.col("v") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)), F.lit(samples - 1)).cast("int")
    counts = long.join(F.broadcast(ends), "plot").groupBy("plot", bins.alias("bin")).count()
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    return every.join(counts, ["plot", "bin"], "left").select("plot", "bin", (F.col("lo") + (F.col("bin") + 0.5) * width).alias("x"), F.coalesce(F.col("count"), F.lit(0)).cast("double").alias("y"))


def weighted_median_bin(plot: DataFrame) -> DataFrame:
    """For each plot the bin where the running sum of x * y comes nearest to half of it."""
    from pyspark.sql import Window

    w = Window.partitionBy("plot").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.col("x") * F.col("y")).over(Window.partitionBy("plot"))
    run = plot.withColumns({"run": F.sum(F.col("x") * F.col("y")).over(w), "total": total})
    return run.groupBy("plot").agg(F.min_by("bin", F.struct(F.abs(F.col("run") - F.col("total") / 2), F.col("bin"))).alias("bin"))


def slicing(df: DataFrame, domain: Domain, fields: list[str], thickness: float = 1.0, direction=(1.0, 0.0, 0.0), average: list[str] = (), images: bool = True) -> DataFrame:
    """plot, bin, x (position), y: sums or means of fields in slices along a direction from the domain's centre.

    With `images` two periodic images a side that lie within the disk around the
    axis count too, those beyond the ends in the first and last slice; without,
    particles only. Slices nothing falls into have y = 0. Rows with a null
    position take no part, null values count as rows only.
    """
    length = math.sqrt(sum(d * d for d in direction))
    unit = [d / length for d in direction]
    mid = [lo + s / 2 for lo, s in zip(domain.bmin, domain.size)]
    ok = F.col("rx").isNotNull() & F.col("ry").isNotNull() & F.col("rz").isNotNull()
    p = df.where(ok)
    base = p.agg(F.min(dot(matvec(domain.xform, sub(vec("r"), lits(mid))), lits(unit))).alias("lo"), F.max(dot(matvec(domain.xform, sub(vec("r"), lits(mid))), lits(unit))).alias("hi")).first()
    if base.lo is None:
        return df.sparkSession.createDataFrame([], "plot string, bin int, x double, y double")
    count = max(1, math.ceil((base.hi - base.lo) / thickness))
    steps = list(itertools.product(*((-2, -1, 0, 1, 2) if images and periodic else (0,) for periodic in domain.periodic)))
    disk = sum(x * x for x in (sum(domain.xform[3 * i + j] * domain.size[j] for j in range(3)) for i in range(3)))
    shifts = F.array(*(F.struct(*(F.lit(float(k * s)).alias(f"s{a}") for k, s, a in zip(o, domain.size, AXES))) for o in steps))
    spread = p.select(*(f"r{a}" for a in AXES), *(F.col(f).cast("double").alias(f"__{f}") for f in fields), F.inline(shifts)) if len(steps) > 1 else p.select(*(f"r{a}" for a in AXES), *(F.col(f).cast("double").alias(f"__{f}") for f in fields), *(F.lit(0.0).alias(f"s{a}") for a in AXES))
    r = tuple(F.col(f"r{a}") - m + F.col(f"s{a}") for a, m in zip(AXES, mid))
    pos = dot(matvec(domain.xform, r), lits(unit))
    spread = spread.withColumn("pos", pos)
    if images:
        off = sub(tuple(F.col("pos") * u for u in unit), r)
        spread = spread.where(norm2(off) <= disk)
    slot = F.greatest(F.least(((F.col("pos") - base.lo) / thickness).cast("long"), F.lit(count - 1).cast("long")), F.lit(0).cast("long")).cast("int")
    sums = spread.groupBy(slot.alias("bin")).agg(F.count("*").alias("n"), *(F.sum(f"__{f}").alias(f"__{f}") for f in fields))
    value = lambda f: F.coalesce(F.col(f"__{f}") / F.col("n") if f in average else F.col(f"__{f}"), F.lit(0.0))
    every = df.sparkSession.range(count).select(F.col("id").cast("int").alias("bin")).join(sums, "bin", "left")
    return every.select("bin", (F.lit(base.lo) + (F.col("bin") + 0.5) * thickness).alias("x"), F.inline(F.array(*(F.struct(F.lit(f).alias("plot"), value(f).alias("y")) for f in fields)))).select("plot", "bin", "x", "y")


def cell_counts(df: DataFrame, domain: Domain) -> DataFrame:
    """ci, cj, ck, n of the cells that hold particles."""
    return domain.with_cells(df).groupBy("ci", "cj", "ck").count().withColumnRenamed("count", "n")


def grid_stats(df: DataFrame, domain: Domain) -> DataFrame:
    """Cells, empty cells, particles, and the least, mean and greatest number in a cell; particles outside the grid apart."""
    total = math.prod(domain.grid_dims)
    counts = cell_counts(df, domain)
    inside = F.lit(True)
    for c, d in zip(("ci", "cj", "ck"), domain.grid_dims):
        inside = inside & (F.col(c) >= 0) & (F.col(c) < d)
    inside = F.coalesce(inside, F.lit(False))
    held = counts.agg(F.count(F.when(inside, 1)).alias("used"), F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("particles"), F.min(F.when(inside, F.col("n"))).alias("lo"), F.max(F.when(inside, F.col("n"))).alias("hi"), F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("outside"))
    return held.select(F.lit(total).cast("long").alias("cells"), (F.lit(total) - F.col("used")).alias("empty_cells"), "particles", F.when(F.col("used") < total, F.lit(0)).otherwise(F.coalesce("lo", F.lit(0))).cast("long").alias("min_particles"), (F.col("particles") / total).alias("avg_particles"), F.coalesce("hi", F.lit(0)).cast("long").alias("max_particles"), "outside")


def cell_costs(df: DataFrame, domain: Domain, coefficients=(0.0, 0.0, 1.0, 0.0), type_weights: dict[int, float] | None = None) -> DataFrame:
    """ci, cj, ck, cost: a cubic of the density, coefficients of the cube first; types may weigh differently."""
    weight = F.lit(1.0)
    for t, w in (type_weights or {}).items():
        weight = F.when(F.col("type") == t, F.lit(float(w))).otherwise(weight)
    rho = domain.with_cells(df).groupBy("ci", "cj", "ck").agg(F.sum(weight).alias("n")).withColumn("d", F.col("n") / domain.cell_size**3)
    a, b, c, e = map(float, coefficients)
    return rho.select("ci", "cj", "ck", (F.lit(a) * F.col("d") * F.col("d") * F.col("d") + F.lit(b) * F.col("d") * F.col("d") + F.lit(c) * F.col("d") + e).alias("cost"))


def fit_cost_model(measured: DataFrame, samples: int = 256, order: int = 3) -> list[float]:
    """Coefficients [x^3, x^2, x, 1] of time over density, fitted to the means of equal density bins and scaled by the smallest that isn't 0.

    `measured` has density and time. An order above 3 counts as 2.
    """
    degree = order if 1 <= order <= 3 else 2
    ends = measured.agg(F.min("density").alias("lo"), F.max("density").alias("hi")).first()
    if ends.lo is None:
        return [0.0, 0.0, 1.0, 0.0]
    width = (ends.hi - ends.lo) or 1.0
    slot = F.least(F.floor((F.col("density") - ends.lo) / width * samples), F.lit(samples - 1))
    means = measured.groupBy(slot.alias("bin")).agg(F.avg("density").alias("x"), F.avg("time").alias("y"))
    x, y = F.col("x"), F.col("y")
    sums = means.agg(*(F.sum(F.pow(x, k)).alias(f"p{k}") for k in range(2 * degree + 1)), *(F.sum(y * F.pow(x, k)).alias(f"m{k}") for k in range(degree + 1))).first()
    fit = fit_from_sums([sums[f"p{k}"] for k in range(2 * degree + 1)], [sums[f"m{k}"] for k in range(degree + 1)])
    fit = ([*fit] + [0.0] * 4)[:4][::-1]
    least = min((abs(c) for c in fit if c), default=1.0)
    return [c / least for c in fit]


def displaced(df: DataFrame, backup: DataFrame, threshold: float, xform=None, backup_xform=None) -> DataFrame:
    """n particles that moved by the threshold or more since the backup (id, rx, ry, rz), and whether there is one.

    With the deformations of both times the distance is taken in lab space.
    """
    now, old = vec("r"), tuple(F.col(f"__b{a}") for a in AXES)
    if xform is not None:
        now, old = matvec(xform, now), matvec(backup_xform or xform, old)
    joined = df.join(backup.select("id", *(F.col(f"r{a}").alias(f"__b{a}") for a in AXES)), "id")
    return joined.agg(F.count(F.when(norm2(sub(now, old)) >= threshold * threshold, 1)).alias("n")).select("n", (F.col("n") > 0).alias("result"))


def performance_advice(particles: int, cells: int, threads: int, cell_size: float, ghost_dist: float = 0.0) -> list[str]:
    """Hints when tasks have too little to do, or cells are too many or smaller than the ghost distance."""
    out = []
    if particles < 100 * threads:
        out.append(f"fewer than 100 particles a thread: {particles} on {threads}")
    if cells > 100 * threads and cell_size < ghost_dist:
        out.append(f"more than 100 cells a thread that are smaller than the ghost distance: {cells}")
    if cells > 100_000 * threads:
        out.append(f"more than 100000 cells a thread: {cells}")
    return out
