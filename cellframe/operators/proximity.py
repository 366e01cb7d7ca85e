"""Pairs of points closer than a distance, across cell faces and periodic faces.

Work is on distinct positions, so copies at one place never pair with each
other. The ball around a point is covered adaptively: by the coarse cells it
meets, which are boundary cells whose points get the exact test, and where such
a cell holds many positions by fine cells whose diagonal is the distance. The
fine cell of the point itself is interior: the join alone accepts its points.
Those around it that the ball can reach are boundary cells again. Only points
near a coarse face are copied to the cell beyond it, and a pair within one
coarse cell is looked for from one side only.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.domain import AXES, Domain
from cellframe.operators.skew import heavy_keys
from cellframe.runtime import Scratch, join_checked

FAR = 1e15


def _number(domain: Domain, axis: int, width: float) -> tuple[float, int | None]:
    """Cell width on an axis, and the number of cells if it is periodic (a whole number must fit)."""
    if not domain.periodic[axis]:
        return width, None
    n = max(1, math.floor(domain.size[axis] / width))
    return domain.size[axis] / n, n


def _index(domain: Domain, axis: int, width: float, n: int | None, x: Column) -> Column:
    k = F.floor(F.greatest(F.least((x - domain.bmin[axis]) / width, F.lit(FAR)), F.lit(-FAR))).cast("long")
    return F.least(k, F.lit(n - 1).cast("long")) if n else k


def _gap(domain: Domain, axis: int, a: Column, b: Column) -> Column:
    """Separation on an axis: to the nearest image if the axis is periodic."""
    d = F.abs(a - b)
    return F.least(d, F.lit(domain.size[axis]) - d) if domain.periodic[axis] else d


def _close(domain: Domain, distance: float) -> Column:
    d2 = sum((_gap(domain, i, F.col(f"a{a}"), F.col(f"b{a}")) * _gap(domain, i, F.col(f"a{a}"), F.col(f"b{a}")) for i, a in enumerate(AXES[1:], 1)), _gap(domain, 0, F.col("ax"), F.col("bx")) * _gap(domain, 0, F.col("ax"), F.col("bx")))
    return (F.sqrt(d2) > 0) & (F.sqrt(d2) <= distance)


def _copies(domain: Domain, widths, numbers, reach: float) -> Column:
    """Cells that a position is in or within `reach` of, as an array of structs (kx, ky, kz, home)."""
    options = []
    for i, a in enumerate(AXES):
        x, k, n, w = F.col(a), F.col(f"h{a}"), numbers[i], widths[i]
        inside = x - domain.bmin[i] - k * w
        wrap = (lambda c, n=n: F.pmod(c, F.lit(n).cast("long"))) if n else (lambda c: c)
        steps = F.array(k, F.when(inside <= reach, wrap(k - 1)), F.when(w - inside <= reach, wrap(k + 1)))
        options.append(F.array_distinct(F.filter(steps, lambda c: c.isNotNull())))
    cells = F.flatten(F.flatten(F.transform(options[0], lambda i: F.transform(options[1], lambda j: F.transform(options[2], lambda k: F.struct(i.alias("kx"), j.alias("ky"), k.alias("kz")))))))
    return cells


def position_pairs(positions: DataFrame, domain: Domain, distance: float, dense: int = 64, coarse: float = 8.0) -> DataFrame:
    """Unordered pairs of distinct positions x, y, z (wrapped) with 0 < d <= distance: ax..az, bx..bz.

    Each pair comes out once, one way round: within a coarse cell by the order of
    its ends or by the direction of the fine cells, of two coarse cells in the
    smaller one. Positions must be distinct rows.
    """
    for i in range(3):
        if domain.periodic[i] and domain.size[i] < 3 * distance:
            raise ValueError("a periodic axis is shorter than three distances: images would meet twice")
    spark, scratch = positions.sparkSession, Scratch(positions.sparkSession, "near")
    widths, numbers = zip(*(_number(domain, i, coarse * distance) for i in range(3)))
    home = positions.withColumns({f"h{a}": _index(domain, i, widths[i], numbers[i], F.col(a)) for i, a in enumerate(AXES)})
    full = scratch.save(home.groupBy("hx", "hy", "hz").count().where(F.col("count") > dense).select(*(F.col(f"h{a}").alias(f"k{a}") for a in AXES)), "dense")
    crowded = full.count()
    keys = ["kx", "ky", "kz"]
    reach = distance * (1 + 1e-9)
    left = home.select(*(F.col(f"h{a}").alias(f"k{a}") for a in AXES), *(F.col(a).alias(f"a{a}") for a in AXES))
    right = home.select(*(F.col(a).alias(f"b{a}") for a in AXES), *(F.col(f"h{a}").alias(f"g{a}") for a in AXES), F.inline(_copies(domain, widths, numbers, reach)))
    # A pair of two cells is found in the smaller one only, a pair of one cell once by its order.
    cell = lambda p: F.struct(*(F.col(f"{p}{a}") for a in AXES))
    right = right.where(cell("g") >= cell("k"))
    order = F.struct(*(F.col(f"a{a}") for a in AXES)) < F.struct(*(F.col(f"b{a}") for a in AXES))
    once = (cell("g") > cell("k")) | order
    both = ["ax", "ay", "az", "bx", "by", "bz"]
    if not crowded:
        return left.join(right, keys).where(once & _close(domain, distance)).select(*both)
    sparse = join_checked(left, full, keys, "left_anti", crowded).join(right, keys).where(once & _close(domain, distance)).select(*both)
    packed = [join_checked(side, full, keys, "left_semi", crowded) for side in (left, right)]
    return sparse.unionByName(_crowded(domain, distance, *packed, once, keys).select(*both))


def _crowded(domain: Domain, distance: float, left: DataFrame, right: DataFrame, once: Column, keys: list[str]) -> DataFrame:
    """The pairs of crowded coarse cells, by fine cells whose diagonal is the distance."""
    side = distance / math.sqrt(3) * (1 - 1e-9)
    widths, numbers = zip(*(_number(domain, i, side) for i in range(3)))
    widths = [min(w, side) if n is None else domain.size[i] / math.ceil(domain.size[i] / side) for i, (w, n) in enumerate(zip(widths, numbers))]
    numbers = [None if n is None else math.ceil(domain.size[i] / side) for i, n in enumerate(numbers)]
    fine = lambda p: [_index(domain, i, widths[i], numbers[i], F.col(f"{p}{a}")) for i, a in enumerate(AXES)]
    reach = [math.ceil(distance / w) for w in widths]
    around = [o for o in itertools.product(*(range(-r, r + 1) for r in reach)) if sum((max(0, abs(k) - 1) * w) ** 2 for k, w in zip(o, widths)) <= distance**2]
    listed = lambda cells: F.expr(f"array({', '.join('named_struct(' + ', '.join(f'{chr(39)}o{a}{chr(39)}, {v}L' for v, a in zip(o, AXES)) + ')' for o in cells)})")
    home = F.lit(True)
    for a in AXES:
        home = home & (F.col(f"g{a}") == F.col(f"k{a}"))
    # Within one coarse cell half of the directions do; a copy from another cell is met from there alone, so it takes all.
    offsets = F.when(home, listed([o for o in around if o >= (0, 0, 0)])).otherwise(listed(around))
    spread = right.withColumns(dict(zip(("fx", "fy", "fz"), fine("b")))).select("*", F.inline(offsets))
    wrap = lambda c, n: F.pmod(c, F.lit(n).cast("long")) if n else c
    spread = spread.withColumns({f"f{a}": wrap(F.col(f"f{a}") + F.col(f"o{a}"), numbers[i]) for i, a in enumerate(AXES)})
    spread = spread.withColumn("same", (F.col("ox") == 0) & (F.col("oy") == 0) & (F.col("oz") == 0)).drop("ox", "oy", "oz")
    kept = left.withColumns(dict(zip(("fx", "fy", "fz"), fine("a"))))
    bounded = F.abs(F.col("az")) < FAR * min(widths) / 2
    for i, a in enumerate(AXES):
        if not domain.periodic[i]:
            bounded = bounded & (F.abs(F.col(f"a{a}")) < 1e6 * max(1.0, domain.size[i]))
    differ = (F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by")) | (F.col("az") != F.col("bz"))
    accepted = F.col("same") & bounded & differ
    return kept.join(spread, [*keys, "fx", "fy", "fz"]).where((once | ~F.col("same")) & (accepted | _close(domain, distance)))


def near_classes(points: DataFrame, domain: Domain, distance: float, dense: int = 64) -> tuple[DataFrame, DataFrame]:
    """The compact form of near_pairs: (links, members).

    `links` are the pairs of distinct positions (ax, ay, az, bx, by, bz) with
    0 < d <= distance, each once; `members` says which ids stand at which position
    (id, x, y, z). Both are as long as the data however many ids share a position.
    """
    scratch = Scratch(points.sparkSession, "near")
    finite = F.col("id").isNotNull()
    for a in AXES:
        finite = finite & (F.abs(F.col(f"r{a}")) < float("inf"))
    rows = points.where(finite).select(F.col("id").cast("long").alias("id"), *(domain.wrapped(i, F.col(f"r{a}").cast("double")).alias(a) for i, a in enumerate(AXES)))
    members = scratch.save(rows.select("id", *((F.col(a) + F.lit(0.0)).alias(a) for a in AXES)).distinct(), "members")
    return scratch.save(position_pairs(members.select(*AXES).distinct(), domain, distance, dense), "links"), members


def _with_ids(links: DataFrame, members: DataFrame, side: str, hot: list, salts: int = 32) -> DataFrame:
    """links joined with the ids at one end; the ids of hot positions are spread over tasks, their links repeated in each."""
    on = [f"{side}{a}" for a in AXES]
    ids = members.select(F.col("id").alias(side), *(F.col(a).alias(f"{side}{a}") for a in AXES))
    if not hot:
        return links.join(ids, on)
    full = F.xxhash64(*on).isin(hot)
    spread = F.when(full, F.pmod(F.xxhash64(side), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    copies = F.when(full, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return links.withColumn("__salt", F.explode(copies)).join(ids.withColumn("__salt", spread), [*on, "__salt"]).drop("__salt")


def near_pairs(points: DataFrame, domain: Domain, distance: float, dense: int = 64) -> DataFrame:
    """Distinct id pairs a < b that have rows with 0 < d <= distance.

    `points` has id, rx, ry, rz; the distance is taken on positions wrapped along
    periodic axes, to the nearest image. Rows with null id or a null or
    non-finite coordinate take no part; repeated rows and further columns change
    nothing; an empty table gives no pairs. Positions at one place (d = 0) are no
    pair, however many ids share it. Where many ids share positions near_classes
    gives the same in a compact form.
    """
    links, members = near_classes(points, domain, distance, dense)
    shared = members.groupBy(F.xxhash64(*AXES).alias("place")).count()
    hot = [r.place for r in heavy_keys(shared, "place", "count", members.count()).collect()]
    found = _with_ids(_with_ids(links, members, "a", hot), members, "b", hot)
    return found.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
