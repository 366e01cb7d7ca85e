"""The periodic distance join and what is computed over its pairs."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.domain import AXES, Domain
from cellframe.functions.vec import matvec, norm2
from cellframe.runtime import Scratch, join_checked

#: Positions of a bucket up to which one task compares them all.
CROWD = 4096


def nbh_dist(domain: Domain, rcut_max: float = 0.0, rcut_inc: float = 0.0, ghost_dist_max: float = 0.0, bond_max_dist: float = 0.0, bond_max_stretch: float = 0.0) -> dict[str, float]:
    """Search and ghost distances, and the displacement after which lists are built anew."""
    low, high = domain.scales
    lab = rcut_max + rcut_inc
    bond = bond_max_dist * (1.0 + bond_max_stretch) / low
    return {
        "nbh_dist_lab": lab,
        "nbh_dist": lab / low,
        "max_displ_lab": rcut_inc / 2,
        "max_displ": rcut_inc / 2 / high,
        "ghost_dist": max(bond, (max(ghost_dist_max, rcut_max) + rcut_inc) / low),
    }


def _axis_copies(domain: Domain, axis: int, x: Column, width: float, n: int | None, reach: float) -> Column:
    """Buckets of an axis that see the position: structs of bucket and image shift."""
    k = F.floor((x - domain.bmin[axis]) / width).cast("long")
    if n:
        k = F.least(F.greatest(k, F.lit(0).cast("long")), F.lit(n - 1).cast("long"))
    layers = max(1, math.ceil(reach / width - 1e-12))
    out = []
    for o in range(-layers, layers + 1):
        at = k + o
        bucket = F.pmod(at, F.lit(n).cast("long")) if n else at
        shift = (bucket - at).cast("double") * width if n else F.lit(0.0)
        entry = F.struct(bucket.alias("k"), shift.alias("s"))
        lo = domain.bmin[axis] + at * width  # lower face of that bucket
        seen = (x >= lo - reach) & (x <= lo + width + reach)
        out.append(entry if o == 0 else F.when(seen, entry))
    return F.filter(F.array(*out), lambda e: e.isNotNull())


def neighbors(df: DataFrame, domain: Domain, rcut: float, coincident: bool = False, keep: tuple[str, ...] = (), half: bool = False, own: tuple[str, ...] = ()) -> DataFrame:
    """Directed pairs (a, b, dx, dy, dz, d2) with 0 < d2 <= rcut^2 in lab space.

    Each image of a periodic axis that is near enough is a pair of its own, a
    particle's image of itself too. With `coincident` pairs at distance 0 of
    different particles count as well; with `half` only a > b is kept. Columns
    named in `keep` come from the neighbour, as nb_<name>, those in `own` from the
    particle itself, as own_<name>. Rows with a null id or
    position, or a non-finite one, have no pairs; a repeated row pairs as often
    as it is there; an empty table gives no rows.

    Buckets are at least rcut wide, and only positions within rcut of a face are
    copied to the bucket beyond it. A bucket of more than CROWD positions is cut
    by id into parts of about so many, each of which meets the whole bucket in a
    task of its own; finding these buckets takes one pass over the positions.
    """
    reach = rcut / domain.scales[0] * (1 + 1e-12)
    good = F.col("id").isNotNull()
    for a in AXES:
        good = good & (F.abs(F.col(f"r{a}")) < 1e15)
    p = domain.wrap(df.where(good))
    widths, counts = [], []
    for i in range(3):
        n = max(1, math.floor(domain.size[i] / reach)) if reach > 0 else 1
        widths.append(domain.size[i] / n)
        counts.append(n if domain.periodic[i] else None)
    if reach <= 0:
        raise ValueError("the distance must be positive")
    keys = ["kx", "ky", "kz"]

    def bucket(i, x):
        k = F.floor((x - domain.bmin[i]) / widths[i]).cast("long")
        return F.least(F.greatest(k, F.lit(0).cast("long")), F.lit(counts[i] - 1).cast("long")) if counts[i] else k

    left = p.select(*(bucket(i, F.col(f"r{a}")).alias(k) for i, (a, k) in enumerate(zip(AXES, keys))), F.col("id").alias("a"), *(F.col(f"r{a}").alias(f"a{a}") for a in AXES), *(F.col(k).alias(f"own_{k}") for k in own))
    right = p.select(F.col("id").alias("b"), *(F.col(f"r{a}") for a in AXES), *(F.col(k).alias(f"nb_{k}") for k in keep))
    for i, (a, k) in enumerate(zip(AXES, keys)):
        right = right.withColumn("c", F.explode(_axis_copies(domain, i, F.col(f"r{a}"), widths[i], counts[i], reach)))
        right = right.withColumns({k: F.col("c.k"), f"b{a}": F.col(f"r{a}") + F.col("c.s")}).drop("c", f"r{a}")
    on = keys
    crowded = Scratch(df.sparkSession, "crowded").save(left.groupBy(*keys).count().where(F.col("count") > CROWD).select(*keys, F.ceil(F.col("count") / CROWD).cast("int").alias("__parts")), "buckets")
    if n := crowded.count():
        one = F.coalesce("__parts", F.lit(1))
        left = join_checked(left, crowded, keys, "left", n).withColumn("__part", F.pmod(F.xxhash64("a"), one)).drop("__parts")
        right = join_checked(right, crowded, keys, "left", n).withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), one - F.lit(1).cast("long")))).drop("__parts")
        on = [*keys, "__part"]
    pairs = left.join(right, on)
    d = matvec(domain.xform, tuple(F.col(f"b{a}") - F.col(f"a{a}") for a in AXES))
    pairs = pairs.select("a", "b", *(c.alias(f"d{a}") for c, a in zip(d, AXES)), *(f"nb_{k}" for k in keep), *(f"own_{k}" for k in own))
    pairs = pairs.withColumn("d2", norm2(tuple(F.col(f"d{a}") for a in AXES)))
    low = (F.col("d2") > 0) | ((F.col("a") != F.col("b")) if coincident else F.lit(False))
    pairs = pairs.where(low & (F.col("d2") <= rcut * rcut))
    return pairs.where(F.col("a") > F.col("b")) if half else pairs


def primary(df: DataFrame, domain: Domain, rcut: float) -> DataFrame:
    """Each unordered pair once, the smaller id first, by grid-space distance; particles at one place are kept."""
    flat = domain.override(xform=(1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0))
    return neighbors(df, flat, rcut, coincident=True).where(F.col("a") < F.col("b"))


def dual(pairs: DataFrame) -> DataFrame:
    """The same pairs seen from the other end."""
    return pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), *((-F.col(f"d{a}")).alias(f"d{a}") for a in AXES), "d2")


def empty_pairs(spark) -> DataFrame:
    return spark.createDataFrame([], "a long, b long, dx double, dy double, dz double, d2 double")


def cell_pair_offsets(domain: Domain, distance: float, subdiv: int = 1) -> list[tuple[int, int, int]]:
    """Offsets of sub-cells whose boxes come closer than the distance."""
    side = domain.cell_size / subdiv
    n = math.ceil(distance / side)
    return [o for o in itertools.product(range(-n, n + 1), repeat=3) if sum((max(0, abs(k) - 1) * side) ** 2 for k in o) < distance**2]


def neighbor_stats(df: DataFrame, pairs: DataFrame, min_pair_dist: float = 0.0, max_pair_dist: float | None = None) -> DataFrame:
    """One row: pairs, average, least and most neighbours of a particle (0 included), least and greatest distance.

    Raises if a distance lies outside [min_pair_dist, max_pair_dist] where a maximum is given.
    """
    each = pairs.groupBy("a").agg(F.count("*").alias("n"), F.min("d2").alias("lo"), F.max("d2").alias("hi"))
    every = df.where(F.col("id").isNotNull()).select(F.col("id").alias("a")).distinct().join(each, "a", "left")
    out = every.agg(F.sum(F.coalesce("n", F.lit(0))).alias("pairs"), F.avg(F.coalesce("n", F.lit(0))).alias("nbh_avg"), F.min(F.coalesce("n", F.lit(0))).alias("nbh_min"), F.max(F.coalesce("n", F.lit(0))).alias("nbh_max"), F.sqrt(F.min("lo")).alias("dist_min"), F.sqrt(F.max("hi")).alias("dist_max"))
    if max_pair_dist is not None:
        bad = (F.col("dist_min") < min_pair_dist) | (F.col("dist_max") > max_pair_dist)
        out = out.withColumn("dist_max", F.when(bad, F.raise_error(F.lit("a pair distance is outside its limits")).cast("double")).otherwise(F.col("dist_max")))
    return out


def average_neighbors(df: DataFrame, pairs: DataFrame, field: str, out: str, rcut: float, weights=(1.0,)) -> DataFrame:
    """Adds the weighted mean of a field over the neighbours within rcut; 0 without neighbours.

    `pairs` must carry nb_<field>. The weight is a polynomial of the distance, of
    up to four coefficients, lowest power first; a weight sum not above 0 divides by 1.
    """
    d = F.sqrt("d2")
    w = F.lit(0.0)
    for c in reversed(tuple(weights)[:4]):
        w = w * d + float(c)
    sums = pairs.where(F.col("d2") <= rcut * rcut).withColumn("w", w).groupBy("a").agg(F.sum(F.col("w") * F.col(f"nb_{field}")).alias("s"), F.sum("w").alias("w"))
    mean = sums.select(F.col("a").alias("id"), (F.col("s") / F.when(F.col("w") > 0, F.col("w")).otherwise(1.0)).alias(out))
    return df.drop(out).join(mean, "id", "left").fillna({out: 0.0})


def pair_force(df: DataFrame, pairs: DataFrame, derivative: Column, energy: Column | None = None) -> DataFrame:
    """Adds sum over neighbours of dE/dr / r times the separation to fx, fy, fz (and half the energies as `ep`)."""
    scale = derivative / F.sqrt("d2")
    sums = [F.sum(scale * F.col(f"d{a}")).alias(f"__f{a}") for a in AXES]
    if energy is not None:
        sums.append((F.sum(energy) * 0.5).alias("__ep"))
    total = pairs.groupBy("a").agg(*sums).withColumnRenamed("a", "id")
    joined = df.join(total, "id", "left")
    out = joined.withColumns({f"f{a}": F.col(f"f{a}") + F.coalesce(F.col(f"__f{a}"), F.lit(0.0)) for a in AXES})
    if energy is not None:
        out = out.withColumn("ep", F.coalesce(F.col("__ep"), F.lit(0.0)))
    return out.drop(*(f"__f{a}" for a in AXES), "__ep")


def lennard_jones(df: DataFrame, domain: Domain, epsilon: float | None = None, sigma: float | None = None, rcut: float | None = None, energy: bool = False, by_types: dict | None = None) -> DataFrame:
    """Forces of 4 eps ((s/r)^12 - (s/r)^6) from neighbours within rcut.

    `by_types` gives (epsilon, sigma, rcut) for pairs of types, whichever way
    round; pairs of other types have the general values, or no force if there are
    none.
    """
    r = F.sqrt("d2")
    if by_types is None:
        eps, size, pairs = F.lit(float(epsilon)), F.lit(float(sigma)), neighbors(df, domain, rcut)
    else:
        pair = F.struct(F.least("own_type", "nb_type").alias("t"), F.greatest("own_type", "nb_type").alias("u"))
        general = (epsilon, sigma, rcut) if None not in (epsilon, sigma, rcut) else (0.0, 1.0, 0.0)
        eps, size, cut = (F.lit(float(x)) for x in general)
        for (t, u), values in by_types.items():
            same = (pair["t"] == min(t, u)) & (pair["u"] == max(t, u))
            eps, size, cut = (F.when(same, F.lit(float(x))).otherwise(c) for x, c in zip(values, (eps, size, cut)))
        far = max(general[2], *(v[2] for v in by_types.values()))
        pairs = neighbors(df, domain, far, keep=("type",), own=("type",)).where(F.col("d2") <= cut * cut)
    s6 = F.pow(size / r, 6)
    de = -24.0 * eps * (2.0 * s6 * s6 - s6) / r
    return pair_force(df, pairs, de, 4.0 * eps * (s6 * s6 - s6) if energy else None)


def gravity(df: DataFrame, domain: Domain, types: DataFrame, g: float, rcut: float) -> DataFrame:
    """Attraction g m_a m_b / r^2 by the masses of the types; a type without mass attracts nothing."""
    mass = types.groupBy("type").agg(F.first("mass").alias("__m"))
    heavy = join_checked(df, mass, ["type"], "left", mass.count()).withColumn("__m", F.coalesce("__m", F.lit(0.0)))
    pairs = neighbors(heavy, domain, rcut, keep=("__m",), own=("__m",))
    de = F.lit(float(g)) * F.col("own___m") * F.col("nb___m") / F.col("d2")
    return pair_force(df, pairs, de)


def image_distances(df: DataFrame, domain: Domain, id1: int, id2: int, dist_max: float = -1.0) -> DataFrame:
    """Distances between all images of two particles (rows of two ids: bounded by the images)."""
    one = df.where(F.col("id") == id1).select(*(F.col(f"r{a}").alias(f"a{a}") for a in AXES))
    two = df.where(F.col("id") == id2).select(*(F.col(f"r{a}").alias(f"b{a}") for a in AXES))
    steps = [F.array(*(F.lit(float(k)) for k in ((-1, 0, 1) if domain.periodic[i] else (0,)))) for i in range(3)]
    for i, a in enumerate(AXES):
        two = two.withColumn(f"i{a}", F.explode(steps[i]))
    pairs = one.withColumn("k", F.lit(1)).join(two.withColumn("k", F.lit(1)), "k")
    d = matvec(domain.xform, tuple(F.col(f"b{a}") + F.col(f"i{a}") * domain.size[i] - F.col(f"a{a}") for i, a in enumerate(AXES)))
    out = pairs.select(F.lit(id1).alias("id1"), F.lit(id2).alias("id2"), *(F.col(f"i{a}").cast("int").alias(f"i{a}") for a in AXES), F.sqrt(norm2(d)).alias("distance"))
    return out.where(F.col("distance") <= dist_max) if dist_max >= 0 else out
