"""Triangle meshes: tri(tri_id, v0, v1, v2), bucketed on a uniform grid, and tests of particles against them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.functions.vec import AXES, add, cross, dot, norm2, scaled, sub, vec
from cellframe.operators.ranking import dense_number

TRI = "tri_id int, v0 array<double>, v1 array<double>, v2 array<double>"
#: Triangles up to this number are broadcast, others are joined by bucket.
BROADCAST_TRIANGLES = 200_000


def triangles(spark: SparkSession, vertices, faces) -> DataFrame:
    rows = [(i, *([float(c) for c in vertices[k]] for k in f)) for i, f in enumerate(faces)]
    return spark.createDataFrame(rows, TRI)


def read_triangles(spark: SparkSession, path: str) -> DataFrame:
    """A mesh of a file with lines of corners and of faces: `v x y z` and `f a b c` counted from 1, or lists under `vertices:` and `triangles:` counted from 0.

    Lines keep the order of the file and are numbered on the executors; faces meet
    their corners in three joins. Further columns of a corner or face (as in
    a/b/c) aren't read; a face of an unknown corner raises when it is read.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.monotonically_increasing_id().alias("n"), F.trim("value").alias("line"))
    start = lines.agg(F.min(F.when(F.col("line") == "vertices:", F.col("n"))).alias("v"), F.min(F.when(F.col("line") == "triangles:", F.col("n"))).alias("t")).first()
    numbers = F.regexp_extract_all("line", F.lit(r"[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?"), 0)
    if start.v is not None:
        listed = lines.where(F.col("line").startswith("-")).select("n", numbers.alias("x"))
        (vs, fs), base = ((listed.where((F.col("n") > a) & ((F.col("n") < b) if b > a else F.lit(True))) for a, b in ((start.v, start.t), (start.t, start.v))), 0)
    else:
        heads = F.transform(F.slice(F.split("line", r"\s+"), 2, 3), lambda w: F.split_part(w, F.lit("/"), F.lit(1)))
        vs, fs, base = lines.where(F.col("line").startswith("v ")).select("n", heads.alias("x")), lines.where(F.col("line").startswith("f ")).select("n", heads.alias("x")), 1
    vs = dense_number(vs, ["n"], "at").select("at", F.transform("x", lambda v: v.cast("double")).alias("r"))
    out = dense_number(fs, ["n"], "tri_id").select(F.col("tri_id").cast("int").alias("tri_id"), *((F.col("x")[i].cast("long") - base).alias(f"c{i}") for i in range(3)))
    for i in range(3):
        out = out.join(vs.select(F.col("at").alias(f"c{i}"), F.col("r").alias(f"v{i}")), f"c{i}", "left")
        out = out.withColumn(f"v{i}", F.when(F.col(f"v{i}").isNull(), F.raise_error(F.lit("a face has a corner that isn't there")).cast("array<double>")).otherwise(F.col(f"v{i}")))
    return out.select("tri_id", "v0", "v1", "v2")


def _corner(name: str) -> tuple[Column, Column, Column]:
    return tuple(F.col(name)[i] for i in range(3))


def _touches(lo: np.ndarray, hi: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Which triangles (n x 3 x 3) meet their boxes lo..hi (n x 3): separating axes."""
    mid, half = (lo + hi) / 2, (hi - lo) / 2
    t = tri - mid[:, None, :]
    edges = t[:, [1, 2, 0]] - t
    ok = np.ones(len(t), bool)
    normal = np.cross(edges[:, 0], edges[:, 1])
    axes = [np.broadcast_to(np.eye(3)[i], (len(t), 3)) for i in range(3)] + [normal]
    axes += [np.cross(np.broadcast_to(np.eye(3)[i], (len(t), 3)), edges[:, j]) for i in range(3) for j in range(3)]
    for a in axes:
        p = np.einsum("nij,nj->ni", t, a)
        reach = (half * np.abs(a)).sum(1)
        ok &= (p.min(1) <= reach + 1e-12) & (p.max(1) >= -reach - 1e-12)
    return ok


def bucket(tri: DataFrame, side: float, distance: float = 0.0, origin=(0.0, 0.0, 0.0)) -> DataFrame:
    """celltri: buckets ti, tj, tk of a grid of the given side that a triangle comes within `distance` of, with the triangle."""
    o = [float(x) for x in origin]
    out = tri
    for i, t in enumerate(("ti", "tj", "tk")):
        at = [F.col(v)[i] for v in ("v0", "v1", "v2")]
        lo = F.floor((F.least(*at) - distance - o[i]) / side).cast("int")
        hi = F.floor((F.greatest(*at) + distance - o[i]) / side).cast("int")
        out = out.withColumn(t, F.explode(F.sequence(lo, hi)))

    def clip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                lo = f[["ti", "tj", "tk"]].to_numpy(float) * side + o
                corners = np.stack([np.stack(f[v].to_numpy()) for v in ("v0", "v1", "v2")], 1)
                f = f[_touches(lo - distance, lo + side + distance, corners)]
            yield f

    return out.mapInPandas(clip, f"{TRI}, ti int, tj int, tk int")


def _with_bucket(df: DataFrame, side: float, origin=(0.0, 0.0, 0.0)) -> DataFrame:
    return df.withColumns({t: F.floor((F.col(f"r{a}") - float(o)) / side).cast("int") for t, a, o in zip(("ti", "tj", "tk"), AXES, origin)})


def _few(tri: DataFrame) -> bool:
    return tri.limit(BROADCAST_TRIANGLES + 1).count() <= BROADCAST_TRIANGLES


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that later ones use several times: behind a generator each is computed once a row, not once a use."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _closest(df: DataFrame, r, a, b, c) -> DataFrame:
    """Adds q: weights (u, v, w) of the point of triangle abc that is closest to r, by the region r projects into.

    The products are columns of their own, so that each is computed once.
    """
    ab, ac, ap, bp, cp = sub(b, a), sub(c, a), sub(r, a), sub(r, b), sub(r, c)
    df = _once(df, {f"__d{i}": dot(x, y) for i, (x, y) in enumerate(((ab, ap), (ac, ap), (ab, bp), (ac, bp), (ab, cp), (ac, cp)), 1)})
    d1, d2, d3, d4, d5, d6 = (F.col(f"__d{i}") for i in range(1, 7))
    df = _once(df, {"__vc": d1 * d4 - d3 * d2, "__vb": d5 * d2 - d1 * d6, "__va": d3 * d6 - d5 * d4})
    va, vb, vc = F.col("__va"), F.col("__vb"), F.col("__vc")
    one, zero = F.lit(1.0), F.lit(0.0)
    s_ab, s_ac, s_bc = d1 / (d1 - d3), d2 / (d2 - d6), (d4 - d3) / ((d4 - d3) + (d5 - d6))
    pick = lambda u, v, w: F.struct(u.alias("u"), v.alias("v"), w.alias("w"))
    q = (
        F.when((d1 <= 0) & (d2 <= 0), pick(one, zero, zero))
        .when((d3 >= 0) & (d4 <= d3), pick(zero, one, zero))
        .when((vc <= 0) & (d1 >= 0) & (d3 <= 0), pick(one - s_ab, s_ab, zero))
        .when((d6 >= 0) & (d5 <= d6), pick(zero, zero, one))
        .when((vb <= 0) & (d2 >= 0) & (d6 <= 0), pick(one - s_ac, zero, s_ac))
        .when((va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0), pick(zero, one - s_bc, s_bc))
        .otherwise(pick(va / (va + vb + vc), vb / (va + vb + vc), vc / (va + vb + vc)))
    )
    return _once(df, {"q": q})


def proximity(df: DataFrame, tri: DataFrame, max_dist: float, side: float | None = None) -> DataFrame:
    """id, tri_id, kind, distance, u, v, w, behind: the nearest triangle, edge or vertex within max_dist of each particle.

    kind is triangle, edge or vertex by how many weights aren't 0. Ties go to the
    smaller kind in that order, then to the smaller tri_id. Particles farther than
    max_dist have no row.
    """
    side = side or max(4 * max_dist, 1e-9)
    cells = bucket(tri, side, max_dist)
    joined = _with_bucket(df.select("id", "rx", "ry", "rz"), side).join(F.broadcast(cells) if _few(cells) else cells, ["ti", "tj", "tk"])
    a, b, c, r = _corner("v0"), _corner("v1"), _corner("v2"), vec("r")
    at = _closest(joined, r, a, b, c)
    point = add(add(scaled(a, F.col("q.u")), scaled(b, F.col("q.v"))), scaled(c, F.col("q.w")))
    away = sub(r, point)
    used = sum((F.when(F.col(f"q.{x}") > 0, 1).otherwise(0) for x in "uv"), F.when(F.col("q.w") > 0, 1).otherwise(0))
    behind = dot(sub(r, a), cross(sub(b, a), sub(c, a))) < 0
    at = _once(at.select("id", "tri_id", "q", behind.alias("behind"), *(c.alias(f"o{a}") for c, a in zip(away, AXES))), {"rank": 3 - used})
    away = vec("o")
    far = at.select("id", "tri_id", F.sqrt(norm2(away)).alias("distance"), "rank", "q.u", "q.v", "q.w", "behind").where(F.col("distance") <= max_dist)
    best = far.groupBy("id").agg(F.min(F.struct("distance", "rank", "tri_id", "u", "v", "w", "behind")).alias("b"))
    kind = F.element_at(F.array(F.lit("triangle"), F.lit("edge"), F.lit("vertex")), F.col("b.rank") + 1)
    return best.select("id", "b.tri_id", kind.alias("kind"), "b.distance", "b.u", "b.v", "b.w", "b.behind")


def _hit(p, d, a, b, c) -> Column:
    """Where along d from p the triangle is met (0..1), null if it isn't."""
    e1, e2 = sub(b, a), sub(c, a)
    h = cross(d, e2)
    det = dot(e1, h)
    s = sub(p, a)
    u = dot(s, h) / det
    q = cross(s, e1)
    v = dot(d, q) / det
    t = dot(e2, q) / det
    return F.when(F.abs(det) < 1e-300, None).otherwise(F.when((u >= 0) & (v >= 0) & (u + v <= 1) & (t >= 0) & (t <= 1), t))


def _segments(df: DataFrame, side: float, start, end) -> DataFrame:
    """Rows repeated for every bucket that the box around a segment meets."""
    out = df
    for t, s, e in zip(("ti", "tj", "tk"), start, end):
        out = out.withColumn(t, F.explode(F.sequence(F.floor(F.least(s, e) / side).cast("int"), F.floor(F.greatest(s, e) / side).cast("int"))))
    return out


def collision(df: DataFrame, tri: DataFrame, dt: float, side: float) -> DataFrame:
    """id, tri_id, u: the first triangle that a particle meets on its way r to r + v dt, u of the way along."""
    r, v = vec("r"), vec("v")
    end = add(r, scaled(v, F.lit(float(dt))))
    moving = _segments(df.select("id", *(f"{p}{a}" for p in "rv" for a in AXES)), side, r, end)
    cells = bucket(tri, side)
    joined = moving.join(F.broadcast(cells) if _few(cells) else cells, ["ti", "tj", "tk"])
    met = joined.withColumn("u", _hit(r, scaled(v, F.lit(float(dt))), _corner("v0"), _corner("v1"), _corner("v2"))).where("u is not null")
    return met.groupBy("id").agg(F.min(F.struct("u", "tri_id")).alias("b")).select("id", "b.tri_id", "b.u")


def without_crossings(df: DataFrame, pairs: DataFrame, tri: DataFrame, side: float) -> DataFrame:
    """Neighbour pairs whose segment crosses no triangle; the segment runs from a along (dx, dy, dz), so images are kept apart."""
    at = df.select(F.col("id").alias("a"), *(F.col(f"r{a}") for a in AXES))
    d = vec("d")
    way = pairs.join(at, "a")
    spread = _segments(way, side, vec("r"), add(vec("r"), d))
    cells = bucket(tri, side)
    joined = spread.join(F.broadcast(cells) if _few(cells) else cells, ["ti", "tj", "tk"])
    crossed = joined.where(_hit(vec("r"), d, _corner("v0"), _corner("v1"), _corner("v2")).isNotNull()).select("a", "b", "dx", "dy", "dz").distinct()
    return pairs.join(crossed, ["a", "b", "dx", "dy", "dz"], "left_anti")


def sphere_mesh(radius: float = 1.0, rings: int = 8, segments: int = 12, center=(0.0, 0.0, 0.0)):
    """Vertices and faces of a sphere, outward normals."""
    v = [(center[0], center[1], center[2] + radius)]
    for i in range(1, rings):
        th = math.pi * i / rings
        v += [(center[0] + radius * math.sin(th) * math.cos(2 * math.pi * j / segments), center[1] + radius * math.sin(th) * math.sin(2 * math.pi * j / segments), center[2] + radius * math.cos(th)) for j in range(segments)]
    v.append((center[0], center[1], center[2] - radius))
    at = lambda i, j: 1 + (i - 1) * segments + j % segments
    f = [(0, at(1, j), at(1, j + 1)) for j in range(segments)]
    for i in range(1, rings - 1):
        for j in range(segments):
            f += [(at(i, j), at(i + 1, j), at(i + 1, j + 1)), (at(i, j), at(i + 1, j + 1), at(i, j + 1))]
    f += [(len(v) - 1, at(rings - 1, j + 1), at(rings - 1, j)) for j in range(segments)]
    return v, f
