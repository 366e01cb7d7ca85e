"""Queries over grid_fields: totals of uneven keys, points near points and in regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellframe.domain import AXES, Domain
from cellframe.operators.coverage import regions_of_points
from cellframe.operators.dense_totals import Axis, dense_totals
from cellframe.operators.proximity import near_pairs
from cellframe.plans.catalogue import query, table
from cellframe.runtime import Scratch

NEAR = 0.1
SHARE = 0.015


def sim_domain(spark, folder) -> Domain:
    return Domain.from_row(table(spark, folder, "sim_domain").first())


def cell_type_totals(spark, folder):
    d = sim_domain(spark, folder)
    finite = lambda a: F.when(F.abs(F.col(f"r{a}")) < float("inf"), F.col(f"r{a}"))
    cell = lambda i, a: F.floor(F.least(F.greatest((d.wrapped(i, finite(a)) - d.bmin[i]) / d.cell_size, F.lit(-1.0)), F.lit(float(d.grid_dims[i]))))
    axes = [Axis(n, cell(i, a), d.grid_dims[i]) for i, (n, a) in enumerate(zip(("ci", "cj", "ck"), AXES))]
    return dense_totals(table(spark, folder, "grid_fields"), [*axes, Axis("type", F.col("type"))], {v: F.col(v) for v in ("vx", "vy", "vz")})


WRAPPED = "((({0} % 1950) + 1950) % 1950)"
KEYED = f"""WITH marked AS (
  SELECT *, isfinite(rx) AND isfinite(ry) AND isfinite(rz) AND rz >= 0 AND rz < 1950 AND type IS NOT NULL AS keyed FROM grid_fields),
keys AS (
  SELECT CASE WHEN keyed THEN floor({WRAPPED.format("rx")} / 150)::INT END AS ci, CASE WHEN keyed THEN floor({WRAPPED.format("ry")} / 150)::INT END AS cj,
    CASE WHEN keyed THEN floor(rz / 150)::INT END AS ck, CASE WHEN keyed THEN type END AS type, vx, vy, vz FROM marked)"""


def _sum(v: str) -> str:
    return f"count(*) FILTER (abs({v}) <= 1e12) AS n_{v}, coalesce(sum(CASE WHEN abs({v}) <= 1e12 THEN floor({v} * 1e6 + 0.5)::BIGINT END), 0)::DOUBLE / 1e6 AS sum_{v}"


@query(
    sql=f"""{KEYED}, counted AS (SELECT ci, cj, ck, type, count(*) AS n FROM keys GROUP BY ALL)
SELECT ci, cj, ck, type FROM counted WHERE ci IS NOT NULL AND n >= {SHARE} * (SELECT sum(n) FROM counted)"""
)
def p1_found(spark, folder):
    """Keys (cell, type) that hold at least 1.5 % of all rows."""
    totals = Scratch(spark, "totals").save(cell_type_totals(spark, folder).select("ci", "cj", "ck", "type", "n"), "keys")
    rows = totals.agg(F.sum("n")).first()[0] or 0
    return totals.where(F.col("ci").isNotNull() & (F.col("n") >= SHARE * rows)).select("ci", "cj", "ck", "type")


@query(sql=f"{KEYED} SELECT ci, cj, ck, type, count(*) AS n, {', '.join(map(_sum, ('vx', 'vy', 'vz')))} FROM keys GROUP BY ci, cj, ck, type")
def p1_totals(spark, folder):
    """Rows and totals of v for every cell and type; rows without a key in one row of nulls."""
    return cell_type_totals(spark, folder)


POINTS = f"""WITH points AS (
  SELECT DISTINCT id, {WRAPPED.format("rx")} AS x, {WRAPPED.format("ry")} AS y, rz AS z FROM grid_fields
  WHERE id IS NOT NULL AND isfinite(rx) AND isfinite(ry) AND isfinite(rz))"""
# Buckets one unit wide (1950 of them an axis); every point is put into its bucket and those around it.
NEAR_SQL = f"""buckets AS (SELECT *, floor(x)::INT AS kx, floor(y)::INT AS ky, floor(z)::BIGINT AS kz FROM points),
spread AS (
  SELECT id, x, y, z, (kx + dx + 1950) % 1950 AS kx, (ky + dy + 1950) % 1950 AS ky, kz + dz AS kz FROM buckets,
    (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dz)),
pairs AS (
  SELECT p.id AS a, q.id AS b, least(abs(p.x - q.x), 1950 - abs(p.x - q.x)) AS dx, least(abs(p.y - q.y), 1950 - abs(p.y - q.y)) AS dy, p.z - q.z AS dz
  FROM buckets p JOIN spread q USING (kx, ky, kz) WHERE p.id < q.id),
near AS (SELECT DISTINCT a, b FROM pairs WHERE sqrt(dx * dx + dy * dy + dz * dz) > 0 AND sqrt(dx * dx + dy * dy + dz * dz) <= {NEAR})"""
FORM = " + ".join(f"{('x', 'y', 'z', '1')[i]} * {('x', 'y', 'z', '1')[j]} * quadric[{4 * i + j + 1}]" for i in range(4) for j in range(4))
INSIDE_SQL = f"""inside AS (
  SELECT DISTINCT id AS a, region_id::BIGINT AS b FROM points JOIN regions ON
    coalesce(id >= id_start, true) AND coalesce(id < id_end, true)
    AND (bmin IS NULL OR (x >= bmin[1] AND y >= bmin[2] AND z >= bmin[3])) AND (bmax IS NULL OR (x <= bmax[1] AND y <= bmax[2] AND z <= bmax[3]))
    AND (quadric IS NULL OR {FORM} <= 0))"""


def _near(spark, folder):
    return near_pairs(table(spark, folder, "grid_fields"), sim_domain(spark, folder), NEAR)


def _inside(spark, folder):
    return regions_of_points(table(spark, folder, "grid_fields"), table(spark, folder, "regions"), sim_domain(spark, folder))


@query(sql=f"{POINTS}, {NEAR_SQL}, {INSIDE_SQL} SELECT 'near' AS kind, a, b FROM near UNION ALL SELECT 'inside', a, b FROM inside")
def p2_found(spark, folder):
    """Pairs of ids within 0.1, and the regions that hold an id."""
    inside = _inside(spark, folder).select(F.lit("inside").alias("kind"), F.col("id").alias("a"), F.col("region_id").cast("long").alias("b"))
    return _near(spark, folder).select(F.lit("near").alias("kind"), "a", "b").unionByName(inside)


@query(sql=f"{POINTS}, {NEAR_SQL} SELECT a, b FROM near")
def p2_near(spark, folder):
    return _near(spark, folder)


@query(sql=f"{POINTS}, {INSIDE_SQL} SELECT a AS id, b::INT AS region_id FROM inside")
def p2_inside(spark, folder):
    return _inside(spark, folder)
