"""Queries of operators whose SQL takes another way than the operator: brute force, closed formulas, recursion."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from cellframe.domain import AXES, Domain
from cellframe.functions.keys import uniform_key_sql
from cellframe.operators import analytics, cells, checks, components, deform, mesh, neighbors, transform
from cellframe.plans.catalogue import query, table
from cellframe.plans.particle_queries import ALL, CELLS, PAIRS, RCUT, SPLATS, SUBDIV, SUBKEYS, UNIT, WITH, WRAPPED, ball, emb, projected, rounded, wrapped
from cellframe.plans.pipeline import State, run_pipeline
from cellframe.runtime import Scratch


def digits_sql(c: str, n: int = 5) -> str:
    """A number to n significant digits, as its mantissa and its power of ten."""
    e = f"CASE WHEN {c} = 0 THEN 0 ELSE floor(log10(abs({c}))) END"
    return f"round({c} / pow(10, {e}), {n}) AS {c}, ({e})::INT AS e{c}"


def digits(df, names, n: int = 5):
    for c in names:
        e = F.when(F.col(c) == 0, 0.0).otherwise(F.floor(F.log10(F.abs(F.col(c)))).cast("double"))
        df = df.withColumn(f"e{c}", e.cast("int")).withColumn(c, F.round(F.col(c) / F.pow(F.lit(10.0), F.col(f"e{c}")), n))
    return df


# forces

LJ = "(-24.0 * (2.0 * pow(0.05 / sqrt(d2), 12) - pow(0.05 / sqrt(d2), 6)) / d2)"
LJ_SUMS = ", ".join(f"sum({LJ} * d{a}) AS s{a}" for a in AXES)
LJ_FORCES = ", ".join(f"coalesce(s{a}, 0) AS f{a}" for a in AXES)


@query(sql=f"{WRAPPED}, {PAIRS}, s AS (SELECT a AS id, {LJ_SUMS} FROM n GROUP BY a), t AS (SELECT w.id, {LJ_FORCES} FROM w LEFT JOIN s USING (id)) SELECT id, {', '.join(digits_sql(f'f{a}') for a in AXES)} FROM t")
def lennard_jones_force(spark, folder):
    """Forces of all pairs within the cut, the closest too, to five significant digits."""
    p = transform.zero_force(wrapped(spark, folder))
    return digits(neighbors.lennard_jones(p, UNIT, 1.0, 0.05, RCUT).select("id", "fx", "fy", "fz"), ["fx", "fy", "fz"])


BY_TYPES = {(0, 0): (1.0, 0.05, 0.1), (1, 0): (0.5, 0.04, 0.08), (2, 3): (2.0, 0.03, 0.06)}


def _by_types_sql(k: int) -> str:
    return "CASE " + " ".join(f"WHEN least(ta, tb) = {min(t)} AND greatest(ta, tb) = {max(t)} THEN {v[k]!r}::DOUBLE" for t, v in BY_TYPES.items()) + " END"


MIXED = ", ".join(f"sum(-24.0 * e * (2.0 * pow(s / sqrt(d2), 12) - pow(s / sqrt(d2), 6)) / d2 * d{a}) AS s{a}" for a in AXES)


@query(sql=f"{WRAPPED}, {PAIRS}, ty AS (SELECT *, {_by_types_sql(0)} AS e, {_by_types_sql(1)} AS s, {_by_types_sql(2)} AS c FROM n), s AS (SELECT a AS id, {MIXED} FROM ty WHERE d2 <= c * c GROUP BY a), t AS (SELECT w.id, {LJ_FORCES} FROM w LEFT JOIN s USING (id)) SELECT id, {', '.join(digits_sql(f'f{a}') for a in AXES)} FROM t")
def lennard_jones_by_types(spark, folder):
    """Forces whose depth, size and cut depend on the types of both ends."""
    s = run_pipeline(State(transform.zero_force(wrapped(spark, folder)), UNIT), [{"lennard_jones_force": {"by_types": BY_TYPES}}])
    return digits(s.particles.select("id", "fx", "fy", "fz"), ["fx", "fy", "fz"])


# noise


def gaussian_sql(prefix: str, sigma: float, cut: float | None, seed: int, where: str = "true") -> str:
    keys = [(3 * seed + i, x) for i, x in enumerate(AXES)]
    joins = " ".join(f"JOIN ({uniform_key_sql('(SELECT id FROM p)', 'id', 2 * k + h, f'u{x}{h}')}) k{x}{h} ON a.id = k{x}{h}.id" for k, x in keys for h in (0, 1))
    draw = lambda x: f"sqrt(-2.0 * ln(1.0 - u{x}0)) * cos(2.0 * pi() * u{x}1) * {sigma!r}"
    noise = (lambda x: draw(x) if cut is None else f"greatest(least({draw(x)}, {cut!r}), -{cut!r})")
    return f"{WITH} SELECT a.id, " + ", ".join(f"round({prefix}{x} + CASE WHEN {where} THEN {noise(x)} ELSE 0 END, 9) AS {prefix}{x}" for x in AXES) + f" FROM p a {joins}"


def uniform_sql(prefix: str, sigma: float, seed: int, where: str = "true") -> str:
    joins = " ".join(f"JOIN ({uniform_key_sql('(SELECT id FROM p)', 'id', 3 * seed + i, f'u{x}')}) k{x} ON a.id = k{x}.id" for i, x in enumerate(AXES))
    return f"{WITH} SELECT a.id, " + ", ".join(f"round({prefix}{x} + CASE WHEN {where} THEN (u{x} * 2.0 - 1.0) * {sigma!r} ELSE 0 END, 9) AS {prefix}{x}" for x in AXES) + f" FROM p a {joins}"


RIGHT = {"particle_regions": {"RIGHT": {"bounds": ((0.5, -9.0, -9.0), (9.0, 9.0, 9.0))}}}
IN_RIGHT = "(rx BETWEEN 0.5 AND 9 AND ry BETWEEN -9 AND 9 AND rz BETWEEN -9 AND 9)"


def noisy(spark, folder, stage: str, **kw):
    out = run_pipeline(State(emb(spark, folder), UNIT), [RIGHT, {stage: kw}]).particles
    names = [f"{stage[-1]}{a}" for a in AXES]
    return rounded(out.select("id", *names), names, 9)


@query(sql=gaussian_sql("r", 0.05, 0.04, 5, IN_RIGHT))
def gaussian_noise_r(spark, folder):
    """Noise of a region only, clamped."""
    return noisy(spark, folder, "gaussian_noise_r", sigma=0.05, sigma_cut=0.04, seed=5, region="RIGHT")


@query(sql=gaussian_sql("v", 1.0, None, 1))
def gaussian_noise_v(spark, folder):
    """With the seed that the field and the step give."""
    return noisy(spark, folder, "gaussian_noise_v")


@query(sql=gaussian_sql("f", 0.5, 1.0, 6))
def gaussian_noise_f(spark, folder):
    return noisy(spark, folder, "gaussian_noise_f", sigma=0.5, sigma_cut=1.0, seed=6)


@query(sql=uniform_sql("v", 0.5, 6, IN_RIGHT))
def uniform_noise_v(spark, folder):
    return noisy(spark, folder, "uniform_noise_v", sigma=0.5, seed=6, region="RIGHT")


@query(sql=uniform_sql("f", 0.5, 2))
def uniform_noise_f(spark, folder):
    return noisy(spark, folder, "uniform_noise_f", sigma=0.5)


# checks


@query(
    sql=f"""{WRAPPED}, g AS (SELECT *, id % 7 = 0 AS odd FROM w), d AS (SELECT {', '.join(f"(0.3 * v{a}) - round(0.3 * v{a}) AS d{a}" for a in AXES)}, CASE WHEN odd THEN 0.25 ELSE 0 END AS dv, 0.5 * fy AS da FROM g)
SELECT round(sqrt(sum(dx * dx + dy * dy + dz * dz)), 6) AS pos_error, round(sqrt(sum(dv * dv)), 6) AS vel_error, round(sqrt(sum(da * da)), 6) AS acc_error, 3::BIGINT AS missing FROM d"""
)
def check_values(spark, folder):
    """Moved rows against a written golden table, which has three ids more."""
    golden = wrapped(spark, folder)
    more = spark.range(-3, 0).select("id", *(F.lit(0.0).alias(c) for c in ALL[2:]))
    golden = Scratch(spark, "golden").save(golden.unionByName(more, allowMissingColumns=True), "golden")
    moved = wrapped(spark, folder).withColumns({f"r{a}": F.col(f"r{a}") + 0.3 * F.col(f"v{a}") for a in AXES} | {"vx": F.col("vx") + F.when(F.col("id") % 7 == 0, 0.25).otherwise(0.0), "fy": F.col("fy") * 1.5})
    return rounded(checks.check_values(moved, golden, UNIT, fatal=False), ["pos_error", "vel_error", "acc_error"])


@query(sql=f"{WRAPPED}, c AS (SELECT id, rx + 0.03 AS x, floor(rx / 0.1) AS c FROM w) SELECT id FROM c WHERE NOT (x >= c * 0.1 AND x < c * 0.1 + 0.1)")
def check_particles_inside_cells(spark, folder):
    """The particles that left their cell when all were shifted."""
    s = run_pipeline(State(wrapped(spark, folder), UNIT), ["move_particles", {"shift_r": {"value": (0.03, 0.0, 0.0)}}, "check_particles_inside_cells"])
    return s.bag["check_particles_inside_cells"].select("id")


@query(sql=f"{WRAPPED}, {PAIRS} SELECT a, b, 'only in first' AS why FROM n WHERE d2 > 0.09 * 0.09")
def verify_chunk_neighbors(spark, folder):
    """The list against primary and dual lists of a smaller distance: what is farther stands in the first only."""
    s = run_pipeline(State(wrapped(spark, folder), UNIT), [{"chunk_neighbors": {"rcut": RCUT}}, {"compute_primary_neighbors": {"rcut": 0.09}}, "compute_dual_neighbors", "verify_chunk_neighbors"])
    return s.bag["verify_chunk_neighbors"]


# deformation

SPLINE_Y = ("e * 1.0", "e * 2.0 + 1.0", "3.0 - e")


@query(
    sql=f"""WITH k AS (SELECT e, {', '.join(f'{y} AS y{i}' for i, y in enumerate(SPLINE_Y))}, 8.0 AS h0, 12.0 AS h1 FROM (SELECT unnest(generate_series(0, 8)) AS e)),
m AS (SELECT *, 6 * ((y2 - y1) / h1 - (y1 - y0) / h0) / (2 * (h0 + h1)) AS c FROM k), t AS (SELECT unnest(generate_series(0, 40)) AS step)
SELECT step::INT AS step, e::INT AS element, round(CASE WHEN 0.471327::DOUBLE * step < 8 THEN c * (0.471327::DOUBLE * step) ** 3 / (6 * h0) + y0 * (8 - 0.471327::DOUBLE * step) / h0 + (y1 - c * h0 * h0 / 6) * (0.471327::DOUBLE * step) / h0
  ELSE c * (20 - 0.471327::DOUBLE * step) ** 3 / (6 * h1) + (y1 - c * h1 * h1 / 6) * (20 - 0.471327::DOUBLE * step) / h1 + y2 * (0.471327::DOUBLE * step - 8) / h1 END, 6) AS value FROM m, t"""
)
def xform_time_interpolate(spark, folder):
    """Each element of a matrix by a natural spline over three times."""
    e = np.arange(9.0)
    series = [e, e * 2 + 1, 3 - e]
    rows = [(k, i, round(float(v), 6)) for k in range(41) for i, v in enumerate(deform.interpolated([0.0, 8.0, 20.0], series, 0.471327 * k).ravel())]
    return spark.createDataFrame(rows, "step int, element int, value double")


@query(sql="SELECT step::INT AS step, round(CASE WHEN step <= 4 THEN 1 + 0.1 * step / 4 WHEN step <= 8 THEN 1.1 - 0.2 * (step - 4) / 4 ELSE 0.9 END, 12)::DOUBLE AS m11, 0::DOUBLE AS m12 FROM (SELECT unnest(generate_series(0, 11)) AS step)")
def xform_time_interpolate_byparts(spark, folder):
    """The domain after each step of a series given by parts: products of the parts' quotients."""
    series, d, rows = [np.eye(3).ravel(), (np.eye(3) * 1.1).ravel(), (np.eye(3) * 0.9).ravel()], UNIT, []
    for step in range(12):
        d = deform.by_parts_step(d, [0.0, 1.0, 2.0], series, 0.25, step) if step else d
        rows.append((step, round(d.xform[0], 12), d.xform[1]))
    return spark.createDataFrame(rows, "step int, m11 double, m12 double")


ANGLES = "SELECT n, pi() * (60 + 5 * n) / 180 AS al, pi() * 80 / 180 AS bt, pi() * (70 + n) / 180 AS gm FROM (SELECT unnest(generate_series(0, 6)) AS n)"


@query(sql=f"WITH a AS ({ANGLES}), x AS (SELECT *, (cos(al) - cos(bt) * cos(gm)) / sin(gm) AS x FROM a) SELECT n::INT AS n, 2::DOUBLE AS m11, round(cos(gm) * 3, 9) AS m12, round(cos(bt), 9) AS m13, round(sin(gm) * 3, 9) AS m22, round(x, 9) AS m23, round(sqrt(1 - cos(bt) ** 2 - x * x), 9) AS m33 FROM x")
def deformation_xform(spark, folder):
    """Cells of given angles between their edges, stretched."""
    rows = []
    for n in range(7):
        d = run_pipeline(State(emb(spark, folder), UNIT), [{"deformation_xform": {"angles": tuple(math.radians(x) for x in (60 + 5 * n, 80, 70 + n)), "extension": (2.0, 3.0, 1.0)}}]).domain
        rows.append((n, *(round(d.xform[i], 9) for i in (0, 1, 2, 4, 5, 8))))
    return spark.createDataFrame(rows, "n int, m11 double, m12 double, m13 double, m22 double, m23 double, m33 double")


@query(sql="SELECT n::INT AS n, round((((1 + n * 0.1) + 0.2 * 0.3 * n) * n * n * n), 9)::DOUBLE AS volume FROM (SELECT unnest(generate_series(1, 9)) AS n)")
def domain_volume(spark, folder):
    """Lab volumes of sheared cubes: determinant times size."""
    rows = []
    for n in range(1, 10):
        d = Domain.cube(float(n), n)
        s = run_pipeline(State(emb(spark, folder), d), [{"domain_set_xform": {"xform": (1 + n * 0.1, 0.2, 0.0, 0.0, 1.0, 0.3, float(n), 0.0, 1.0)}}, "domain_volume"])
        rows.append((n, round(s.bag["volume"], 9)))
    return spark.createDataFrame(rows, "n int, volume double")


GROWN = " UNION ALL ".join(f"SELECT '{a}' AS axis, (9 + (min(r{a}) < 0.05)::INT + (max(r{a}) >= 0.95)::INT)::INT AS cells, round(CASE WHEN min(r{a}) < 0.05 THEN -0.05 ELSE 0.05 END, 9)::DOUBLE AS lo, round(CASE WHEN max(r{a}) >= 0.95 THEN 1.05 ELSE 0.95 END, 9)::DOUBLE AS hi FROM w" for a in AXES)


@query(sql=f"{WRAPPED} {GROWN}")
def extend_domain(spark, folder):
    """A closed box grown by a cell on each side where particles lie beyond."""
    box = Domain((0.05,) * 3, (0.95,) * 3, (9, 9, 9), 0.1, (False, False, False), expandable=True)
    d = run_pipeline(State(wrapped(spark, folder), box), ["extend_domain"]).domain
    return spark.createDataFrame([(a, d.grid_dims[i], round(d.bmin[i], 9), round(d.bmax[i], 9)) for i, a in enumerate(AXES)], "axis string, cells int, lo double, hi double")


# cells and components


@query(sql=f"{WRAPPED}, {SPLATS}, c AS (SELECT {SUBKEYS}, count FROM sums WHERE count > 1e-6) SELECT {', '.join(cells.KEY)}, round(count * {' * '.join(f'(1 + (c{n} IN (0, 9))::INT)' for n in 'ijk')}, 6) AS count FROM c")
def update_gcv_from_ghost(spark, folder):
    """Cell values copied beyond the periodic faces, then added back: a cell at a face has its images' values besides."""
    s = State(wrapped(spark, folder), UNIT, cell_values=projected(spark, folder).select(*cells.KEY, "count").where(F.col("count") > 1e-6))
    s = run_pipeline(s, [{"ghost_update_all": {"distance": 0.1, "grid_subdiv": SUBDIV}}, "update_gcv_from_ghost"])
    return rounded(s.cell_values, ["count"])


ZORDER = components.z_order(UNIT, SUBDIV).replace("L", "")
for _c in cells.CELL:
    for _b in range(4):
        ZORDER = ZORDER.replace(f"shiftright({_c}, {_b})", f"({_c} >> {_b})")
TOUCH = " AND ".join(f"(abs(p.k{a} - q.k{a}) <= 1 OR abs(p.k{a} - q.k{a}) = {10 * SUBDIV - 1})" for a in AXES)
MEANS = ", ".join(f"avg(r{a}) AS center_{a}" for a in AXES)
SPREADS = ", ".join(f"round(avg((r{p} - center_{p}) * (r{q} - center_{q})), 9) AS gyr_{p}{q}" for p in AXES for q in AXES)
COMPONENTS = f"""WITH RECURSIVE {(WRAPPED + ', ' + SPLATS).removeprefix('WITH ')}, v AS (SELECT {SUBKEYS}, kx, ky, kz, count, vx FROM sums WHERE count >= 0.2),
on_ AS (SELECT *, {ZORDER} AS u, {', '.join(f'(k{a} + 0.5) * {UNIT.cell_size / SUBDIV!r} AS r{a}' for a in AXES)} FROM v),
e AS (SELECT p.u, q.u AS v FROM on_ p, on_ q WHERE p.u <> q.u AND {TOUCH}),
r(u, label) AS (SELECT u, u FROM on_ UNION SELECT e.v, label FROM r JOIN e USING (u) WHERE label < e.v),
l AS (SELECT u, min(label) AS least FROM r GROUP BY u), big AS (SELECT least, count(*) AS count FROM l GROUP BY least HAVING count(*) >= 2),
named AS (SELECT least, count, row_number() OVER (ORDER BY least) - 1 AS label FROM big), j AS (SELECT named.label, on_.*, named.count AS c FROM named JOIN l USING (least) JOIN on_ USING (u)),
m AS (SELECT label, {MEANS} FROM j GROUP BY label)
SELECT label, max(c) AS count, {', '.join(f'round(max(center_{a}), 9) AS center_{a}' for a in AXES)}, {SPREADS}, round(sum(vx), 6) AS vx FROM j JOIN m USING (label) GROUP BY label"""


@query(sql=COMPONENTS)
def cc_label(spark, folder):
    """Connected sub-cells of projected density, with their table."""
    s = State(wrapped(spark, folder), UNIT, cell_values=Scratch(spark, "cells").save(projected(spark, folder), "v"))
    s = run_pipeline(s, [{"cc_label": {"field": "count", "threshold": 0.2, "grid_subdiv": SUBDIV, "count_threshold": 2, "sums": ["vx"]}}])
    t = s.bag["cc_table"]
    return rounded(rounded(t, [c for c in t.columns if c.startswith(("center", "gyr"))], 9), ["vx"])


@query(
    sql=f"""{WRAPPED}, c AS (SELECT {CELLS}, count(*) / {UNIT.cell_size**3!r} AS x FROM w GROUP BY ALL), t AS (SELECT x, 2 + 3 * x + 0.01 * x * x AS y, min(x) OVER () AS lo, max(x) OVER () AS hi FROM c),
b AS (SELECT avg(x) AS x, avg(y) AS y FROM (SELECT *, least(floor((x - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 256), 255) AS b FROM t) GROUP BY b),
f AS (SELECT regr_slope(y, x) AS c1, regr_intercept(y, x) AS c0 FROM b) SELECT 0::DOUBLE AS c3, 0::DOUBLE AS c2, round(c1 / least(abs(c0), abs(c1)), 6) AS c1, round(c0 / least(abs(c0), abs(c1)), 6) AS c0 FROM f"""
)
def cost_model_fit(spark, folder):
    """A line fitted to the mean times of equal density bins."""
    c = analytics.cell_costs(wrapped(spark, folder), UNIT, (0.0, 0.0, 1.0, 0.0)).select(F.col("cost").alias("density"))
    measured = c.withColumn("time", 2.0 + F.col("density") * 3.0 + 0.01 * F.col("density") * F.col("density"))
    s = run_pipeline(State(wrapped(spark, folder), UNIT), [{"cost_model_fit": {"measured": measured, "order": 1}}])
    return spark.createDataFrame([tuple(round(x, 6) for x in s.bag["cost_model_coefs"])], "c3 double, c2 double, c1 double, c0 double")


@query(sql=f"{WRAPPED} SELECT 8::BIGINT AS blocks, 1000::BIGINT AS cells, 0::BIGINT AS unowned, round(count(*) / {UNIT.cell_size**3!r}, 3) AS cost, 0::DOUBLE AS difference, true AS balanced FROM w")
def load_balance_rcb(spark, folder):
    """Blocks of about equal cost: every cell has one owner, the owners' costs are those of the blocks, none far above the mean."""
    s = run_pipeline(State(wrapped(spark, folder), UNIT), ["simple_cost_model", {"load_balance_rcb": {"parts": 8}}, "cell_owner_rank"])
    owned = s.bag["cell_owner"].join(s.bag["simple_cost_model"], cells.CELL, "left").groupBy("owner").agg(F.count("*").alias("cells"), F.sum("cost").alias("cost"))
    stated = spark.createDataFrame([(i, float(c)) for i, (*_, c) in enumerate(s.bag["blocks"])], "owner int, stated double")
    j = owned.join(stated, "owner", "full")
    return j.agg(F.count("stated").alias("blocks"), F.sum("cells").alias("cells"), F.coalesce(F.sum(F.when(F.col("owner").isNull(), F.col("cells"))), F.lit(0)).alias("unowned"), F.round(F.sum("cost"), 3).alias("cost"), F.round(F.max(F.abs(F.coalesce("cost", F.lit(0.0)) - F.col("stated"))), 3).alias("difference"), (F.max("cost") <= 1.5 * F.avg("cost")).alias("balanced"))


# meshes: brute force over all triangles


def triangles_sql(vertices, faces) -> str:
    rows = ", ".join(f"({i}, {', '.join(f"{float(x)!r}::DOUBLE" for k in f for x in vertices[k])})" for i, f in enumerate(faces))
    return f"tri(tri_id, {', '.join(f'{n}{a}' for n in 'klm' for a in AXES)}) AS (VALUES {rows})"


TRI = triangles_sql(*mesh.sphere_mesh(0.3, 8, 12, (0.5, 0.5, 0.5)))
Vector = tuple[str, str, str]


def v3(name: str) -> Vector:
    return tuple(f"{name}{a}" for a in AXES)


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(f"({x} - {y})" for x, y in zip(a, b))


def inner(a: Vector, b: Vector) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b)) + ")"


def outer(a: Vector, b: Vector) -> Vector:
    return tuple(f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in ((1, 2), (2, 0), (0, 1)))


def segment2(p: Vector, a: Vector, b: Vector) -> str:
    """Squared distance of p to a segment."""
    ab = minus(b, a)
    t = f"greatest(0, least(1, {inner(minus(p, a), ab)} / {inner(ab, ab)}))"
    d = tuple(f"({x} - {y} - {t} * {z})" for x, y, z in zip(p, a, ab))
    return inner(d, d)


A, B, C, N, R = v3("k"), v3("l"), v3("m"), v3("n"), v3("r")
NORMAL = ", ".join(f"{x} AS n{a}" for x, a in zip(outer(minus(B, A), minus(C, A)), AXES))
OVER = " AND ".join(f"{inner(outer(minus(y, x), minus(R, x)), N)} >= 0" for x, y in ((A, B), (B, C), (C, A)))
DISTANCE2 = f"least(CASE WHEN {OVER} THEN {inner(minus(R, A), N)} * {inner(minus(R, A), N)} / {inner(N, N)} ELSE 1e300 END, {segment2(R, A, B)}, {segment2(R, B, C)}, {segment2(R, C, A)})"


@query(sql=f"{WRAPPED}, {TRI}, t AS (SELECT *, {NORMAL} FROM tri), d AS (SELECT id, sqrt(min({DISTANCE2})) AS distance FROM w, t GROUP BY id) SELECT id, round(distance, 9) AS distance FROM d WHERE distance <= 0.1")
def trimesh_proximity(spark, folder):
    """The distance of the particles near a sphere to its triangles."""
    s = run_pipeline(State(wrapped(spark, folder), UNIT, mesh=ball(spark)), [{"trimesh_proximity": {"max_dist": 0.1}}])
    return s.bag["trimesh_proximity"].select("id", F.round("distance", 9).alias("distance"))


V = v3("v")
HIT = tuple(f"({r} + u * {v})" for r, v in zip(R, V))
INSIDE = " AND ".join(f"{inner(outer(minus(y, x), minus(HIT, x)), N)} >= 0" for x, y in ((A, B), (B, C), (C, A)))


@query(sql=f"{WRAPPED}, {TRI}, t AS (SELECT *, {NORMAL} FROM tri), h AS (SELECT id, tri_id, {', '.join([*A, *B, *C, *N, *R, *V])}, {inner(minus(A, R), N)} / nullif({inner(V, N)}, 0) AS u FROM w, t), m AS (SELECT id, tri_id, u FROM h WHERE u >= 0 AND u <= 1 AND {INSIDE}) SELECT id, arg_min(tri_id, u)::INT AS tri_id, round(min(u), 9) AS u FROM m GROUP BY id")
def trimesh_collision(spark, folder):
    """The first triangle that each particle meets in a step of time 1."""
    s = run_pipeline(State(wrapped(spark, folder), UNIT, mesh=ball(spark)), [{"trimesh_collision": {"dt": 1.0}}])
    return s.bag["trimesh_collision"].select("id", "tri_id", F.round("u", 9).alias("u"))


def apart(axis: Vector) -> str:
    """Whether the axis parts the triangle (corners relative to a cell's centre) from the cell."""
    ends = [inner(v, axis) for v in (v3("p"), v3("q"), v3("s"))]
    reach = f"0.05::DOUBLE * ({' + '.join(f'abs({x})' for x in axis)}) + 1e-12"
    return f"(least({', '.join(ends)}) > {reach} OR greatest({', '.join(ends)}) < -({reach}))"


EDGES = [minus(v3("q"), v3("p")), minus(v3("s"), v3("q")), minus(v3("p"), v3("s"))]
AXES3 = [("1", "0", "0"), ("0", "1", "0"), ("0", "0", "1")]
PARTED = " OR ".join(apart(x) for x in [*AXES3, outer(EDGES[0], EDGES[1]), *(outer(u, e) for u in AXES3 for e in EDGES)])
GRID3 = ", ".join(f"(SELECT unnest(generate_series(-1, 10)) AS {t})" for t in ("ti", "tj", "tk"))
MOVED = ", ".join(f"{n}{a} - ({t} + 0.5) * 0.1 AS {m}{a}" for n, m in zip("klm", "pqs") for a, t in zip(AXES, ("ti", "tj", "tk")))


ASKEW = (0.3, 8, 12, (0.513, 0.487, 0.521))  # no corner lies on a cell's face


@query(sql=f"WITH {triangles_sql(*mesh.sphere_mesh(*ASKEW))}, c AS (SELECT tri_id, ti, tj, tk, {MOVED} FROM tri, {GRID3}) SELECT ti::INT AS ti, tj::INT AS tj, tk::INT AS tk, tri_id FROM c WHERE NOT ({PARTED})")
def grid_triangle_intersections(spark, folder):
    """The cells that each triangle meets."""
    s = run_pipeline(State(wrapped(spark, folder), UNIT, mesh=mesh.triangles(spark, *mesh.sphere_mesh(*ASKEW))), ["grid_triangle_intersections"])
    return s.bag["grid_to_triangles"].select("ti", "tj", "tk", "tri_id")


# files and types

NAMED = ", ".join(f"round({c}, 7) AS {c}" for c in ("rx", "ry", "rz", "vx"))


@query(sql=f"{WRAPPED} SELECT w.id, trim(coalesce(name, 'XX')) AS name, {NAMED} FROM w LEFT JOIN particle_types USING (type)")
def write_xyz(spark, folder):
    """The lines of an extended XYZ file, read back."""
    path = Scratch(spark, "xyz").root
    run_pipeline(State(wrapped(spark, folder), UNIT, types=table(spark, folder, "particle_types")), [{"write_xyz": {"path": path, "fields": ("id", "vx")}}])
    parts = F.regexp_extract
    line = r"^(.*?)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\d+)\s+(\S+)$"
    lines = spark.read.text(f"{path}/part-*").select(parts("value", line, 5).cast("long").alias("id"), F.trim(parts("value", line, 1)).alias("name"), *(parts("value", line, i).cast("double").alias(c) for i, c in ((2, "rx"), (3, "ry"), (4, "rz"), (6, "vx"))))
    return rounded(lines, ["rx", "ry", "rz", "vx"], 7)


TYPES = {"A": {"mass": 2.5, "radius": 0.5}, "B": {"mass": 4.0}, "C": {}}
ADDED = {"B": {"charge": -1.0}, "C": {"mass": 8.0}}


@query(sql=f"{WITH}, t(type, name, mass, radius, charge) AS (VALUES (0, 'A', 2.5::DOUBLE, 0.5::DOUBLE, NULL::DOUBLE), (1, 'B', 4.0, NULL, -1.0), (2, 'C', 8.0, NULL, NULL)) SELECT name, count(*) AS n, sum(mass) AS mass, max(radius) AS radius, max(charge) AS charge FROM p JOIN t USING (type) GROUP BY name")
def particle_types(spark, folder):
    """Types given by name, with properties added later, joined to the particles of each."""
    s = run_pipeline(State(emb(spark, folder), UNIT), [{"particle_types": TYPES}, {"particle_type_add_properties": ADDED}])
    return s.particles.join(s.types, "type").groupBy("name").agg(F.count("*").alias("n"), F.sum("mass").alias("mass"), F.max("radius").alias("radius"), F.max("charge").alias("charge"))
