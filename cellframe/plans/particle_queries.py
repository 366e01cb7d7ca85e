"""Queries of the particle and grid operators over particles derived from the driver tables.

Most use the embeddings as points of the unit cube; events and lineitem give
larger sets for aggregates. Sums are rounded in the query and in its SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cellframe.domain import AXES, Domain
from cellframe.functions.keys import uniform_key_sql
from cellframe.operators import analytics, cells, checks, components, deform, mesh, neighbors, partitioning, ranking, selection, snap, transform
from cellframe.operators.regions import Regions, scaling, translation
from cellframe.plans.catalogue import query, table
from cellframe.runtime import Scratch
from cellframe.sources import files, particles
from cellframe.streaming.loop import Verlet, run

UNIT = Domain.cube(1.0, 10)
EVENTS = Domain.cube(30.0, 30, (False, False, False))
RCUT = 0.1
SEED = 42
SHEAR = (1.0, 0.1, 0.0, 0.0, 1.0, 0.05, 0.0, 0.0, 1.0)
REGIONS = Regions().declare("SPHERE", quadric="sphere", transform=translation((0.5, 0.5, 0.5)) @ scaling(0.25)).declare("BOX", bounds=((0.5, 0.0, 0.0), (1.0, 1.0, 1.0))).declare("LOW", id_range=(0, 100))
CSG = "SPHERE and not BOX"
SQL_SPHERE = "(16 * (rx * rx + ry * ry + rz * rz) - 16 * (rx + ry + rz) + 11 <= 0)"
SQL_BOX = "(rx >= 0.5 AND rx <= 1 AND ry >= 0 AND ry <= 1 AND rz >= 0 AND rz <= 1)"
SQL_CSG = f"({SQL_SPHERE} AND NOT {SQL_BOX})"
ALL = ["id", "type", *(f"{p}{a}" for p in "rvf" for a in AXES)]
P = "SELECT vec_id AS id, label AS type, " + ", ".join(f"embedding[{1 + 3 * k + i}]::DOUBLE{' + 0.5' if k == 0 else ''} AS {p}{a}" for k, p in enumerate("rvf") for i, a in enumerate(AXES)) + " FROM embeddings"
WITH = f"WITH p AS ({P})"
WRAP = ", ".join(f"((r{a} % 1) + 1) % 1 AS r{a}" for a in AXES)
OTHER = ", ".join(["id", "type", *(f"{p}{a}" for p in "vf" for a in AXES)])
WRAPPED = f"{WITH}, w AS (SELECT {OTHER}, {WRAP} FROM p)"
KEY6 = ", ".join(cells.KEY)
EV = """WITH kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS type FROM (SELECT DISTINCT event_type FROM events)),
e AS (SELECT event_id AS id, type::INT AS type, epoch_us(ts::TIMESTAMP - INTERVAL 0 SECOND) AS us, (user_id % 30)::DOUBLE AS ry, value / 20 AS rz, value AS vx FROM events JOIN kinds USING (event_type)),
p AS (SELECT id, type, (us - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0 AS rx, ry, rz, vx FROM e)"""


def emb(spark, folder):
    return particles.from_embeddings(table(spark, folder, "embeddings"))


def wrapped(spark, folder):
    return UNIT.wrap(emb(spark, folder)).select(*ALL)


def evt(spark, folder):
    return particles.from_events(table(spark, folder, "events"))


def rounded(df, names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def sel(**changes) -> str:
    return ", ".join(f"{changes[c]} AS {c}" if c in changes else c for c in ALL)


def norm_sql(p: str) -> str:
    return f"sqrt({p}x * {p}x + {p}y * {p}y + {p}z * {p}z)"


def stats_sql(source: str) -> str:
    return f"SELECT count(*) AS n, round(coalesce(sum(vx * vx + vy * vy + vz * vz), 0), 6) AS sum_v2, round(min({norm_sql('v')}), 9) AS min_vel, round(max({norm_sql('v')}), 9) AS max_vel, round(min({norm_sql('f')}), 9) AS min_acc, round(max({norm_sql('f')}), 9) AS max_acc FROM {source}"


def stats(df):
    return rounded(rounded(analytics.simulation_stats(df), ["sum_v2"]), ["min_vel", "max_vel", "min_acc", "max_acc"], 9)


@query(sql=f"{WRAPPED} {stats_sql(f'w WHERE {SQL_CSG}')}")
def region_stats(spark, folder):
    """particle_regions and simulation_stats: a region of the wrapped particles, moved, and its statistics."""
    p = wrapped(spark, folder)
    p = p.where(REGIONS.predicate(CSG, (F.col("rx"), F.col("ry"), F.col("rz")), F.col("id")))
    return stats(transform.shift(p, "r", (0.1, 0.0, 0.0)))


@query(sql=f"{WITH} SELECT {sel(rx=f'CASE WHEN {SQL_CSG} THEN rx + 0.25 ELSE rx END', ry=f'CASE WHEN {SQL_CSG} THEN ry - 0.5 ELSE ry END')} FROM p")
def shift_region(spark, folder):
    return transform.shift(emb(spark, folder), "r", (0.25, -0.5, 0.0), REGIONS, CSG)


@query(sql=f"{WITH} SELECT {sel(vx='vx + 1', vy='vy + 2', vz='vz + 3')} FROM p")
def shift_v(spark, folder):
    return transform.shift(emb(spark, folder), "v", (1.0, 2.0, 3.0))


@query(sql=f"{WITH} SELECT {sel(vx=f'CASE WHEN id < 100 THEN vx * 2 ELSE vx END', vy=f'CASE WHEN id < 100 THEN vy * 3 ELSE vy END', vz=f'CASE WHEN id < 100 THEN vz * 4 ELSE vz END')} FROM p")
def scale_v(spark, folder):
    return transform.scale(emb(spark, folder), "v", (2.0, 3.0, 4.0), REGIONS, "LOW")


@query(sql=f"{WITH} SELECT {sel(rx='rx * 2', ry='ry * 2', rz='rz * 2')} FROM p")
def scale_r(spark, folder):
    return transform.scale(emb(spark, folder), "r", (2.0, 2.0, 2.0))


@query(sql=f"{WITH} SELECT {sel(vx='1.5', vy='0.0', vz='-1.0')} FROM p".replace("1.5 AS", "1.5::DOUBLE AS").replace("0.0 AS", "0.0::DOUBLE AS").replace("-1.0 AS", "-1.0::DOUBLE AS"))
def set_velocity(spark, folder):
    return transform.assign(emb(spark, folder), "v", (1.5, 0.0, -1.0))


@query(sql=f"{WITH} SELECT {sel(fx=f'CASE WHEN {SQL_BOX} THEN 9::DOUBLE ELSE fx END', fy=f'CASE WHEN {SQL_BOX} THEN 8::DOUBLE ELSE fy END', fz=f'CASE WHEN {SQL_BOX} THEN 7::DOUBLE ELSE fz END')} FROM p")
def set_force(spark, folder):
    return transform.assign(emb(spark, folder), "f", (9.0, 8.0, 7.0), REGIONS, "BOX")


@query(sql=f"{WITH} SELECT {sel(fx='0::DOUBLE', fy='0::DOUBLE', fz='0::DOUBLE')} FROM p")
def zero_particle_force(spark, folder):
    return transform.zero_force(emb(spark, folder))


DIVIDE = ", ".join(f"f{a} / nullif(mass, 0) AS f{a}" for a in AXES)


@query(sql=f"{WITH} SELECT id, p.type, {DIVIDE} FROM p LEFT JOIN particle_types USING (type)")
def divide_force_by_type_scalar(spark, folder):
    return transform.divide_force_by_type(emb(spark, folder), table(spark, folder, "particle_types"), "mass").select("id", "type", "fx", "fy", "fz")


@query(sql=f"{WITH} SELECT {sel(**{f'r{a}': f'r{a} + v{a} * 0.01' for a in AXES})} FROM p")
def push_v_r(spark, folder):
    return transform.push_first(emb(spark, folder), "r", "v", 0.02, 0.5)


@query(sql=f"{WITH} SELECT {sel(**{f'v{a}': f'v{a} + f{a} * 0.01' for a in AXES})} FROM p")
def push_f_v(spark, folder):
    return transform.push_first(emb(spark, folder), "v", "f", 0.01)


@query(sql=f"{WITH} SELECT {sel(**{f'r{a}': f'r{a} + f{a} * 0.01' for a in AXES})} FROM p")
def push_f_r(spark, folder):
    return transform.push_first(emb(spark, folder), "r", "f", 0.01)


INV = Domain(xform=SHEAR).inverse
STEP = [f"(v{a} * 0.01 + f{a} * {0.01 * 0.01 * 0.5!r})" for a in AXES]


@query(sql=f"{WITH} SELECT id, " + ", ".join(f"round(r{a} + {' + '.join(f'({INV[3 * i + j]!r} * {STEP[j]})' for j in range(3))}, 9) AS r{a}" for i, a in enumerate(AXES)) + " FROM p")
def push_f_v_r(spark, folder):
    moved = transform.push_second(emb(spark, folder), 0.01, domain=UNIT.override(xform=SHEAR))
    return rounded(moved.select("id", "rx", "ry", "rz"), ["rx", "ry", "rz"], 9)


@query(sql=f"{WITH} SELECT id, rx + 0.1 * ry AS rx, ry + 0.05 * rz AS ry, rz FROM p")
def apply_xform(spark, folder):
    return transform.apply_xform(emb(spark, folder), SHEAR).select("id", "rx", "ry", "rz")


NOISE_KEYS = f"SELECT a.id, {', '.join(f'r{x} + (u{i} * 2.0 - 1.0) * 0.05 AS r{x}' for i, x in enumerate(AXES))} FROM p a " + " ".join(f"JOIN ({uniform_key_sql('(SELECT id FROM p)', 'id', 15 + i, f'u{i}')}) k{i} ON a.id = k{i}.id" for i in range(3))


@query(sql=f"{WITH} {NOISE_KEYS}")
def uniform_noise_r(spark, folder):
    return transform.uniform_noise(emb(spark, folder), "r", 0.05, seed=5).select("id", "rx", "ry", "rz")


@query(sql=f"{WITH} SELECT id, round(((floor(rx / 0.1)) + floor((rx / 0.1 - floor(rx / 0.1)) * 4294967296) / 4294967296) * 0.1, 9) AS rx FROM p")
def backup_restore(spark, folder):
    """backup_r and restore_r: positions moved away and put back from the quantised backup."""
    p = emb(spark, folder)
    moved = transform.shift(p, "r", (5.0, 5.0, 5.0))
    back = transform.restore(moved, transform.backed_up(transform.quantised_backup(p, UNIT), UNIT))
    return rounded(back.select("id", "rx"), ["rx"], 9)


FRACTION = 0.3
COUNT = 50
KEYED = f"{WRAPPED}, k AS (SELECT * FROM ({uniform_key_sql('w', 'id', SEED)})), t AS (SELECT round({FRACTION} * count(*)) / count(*) AS tau FROM k WHERE {SQL_SPHERE})"
RANKED = f"{WRAPPED}, k AS (SELECT * FROM ({uniform_key_sql('w', 'id', SEED)})), n AS (SELECT id, row_number() OVER (ORDER BY u, id) AS place FROM k WHERE {SQL_SPHERE})"


@query(sql=f"{KEYED} SELECT id, (CASE WHEN {SQL_SPHERE} AND u < tau THEN 99 ELSE type END)::INT AS type FROM k, t")
def set_type_fraction(spark, folder):
    return selection.set_particle_type(wrapped(spark, folder), UNIT, 99, REGIONS, "SPHERE", fraction=FRACTION, seed=SEED).select("id", "type")


@query(sql=f"{RANKED} SELECT k.id, (CASE WHEN place <= {COUNT} THEN 99 ELSE type END)::INT AS type FROM k LEFT JOIN n USING (id)")
def set_type_count(spark, folder):
    return selection.set_particle_type(wrapped(spark, folder), UNIT, 99, REGIONS, "SPHERE", count=COUNT, seed=SEED).select("id", "type")


@query(sql=f"{WRAPPED} SELECT id FROM w WHERE NOT {SQL_CSG}")
def remove_region(spark, folder):
    return selection.remove_particles(wrapped(spark, folder), UNIT, REGIONS, CSG).select("id")


@query(sql=f"{KEYED} SELECT id FROM k, t WHERE NOT ({SQL_SPHERE} AND u < tau)")
def remove_fraction(spark, folder):
    return selection.remove_particles(wrapped(spark, folder), UNIT, REGIONS, "SPHERE", fraction=FRACTION, seed=SEED).select("id")


@query(sql=f"{RANKED} SELECT k.id FROM k LEFT JOIN n USING (id) WHERE place IS NULL OR place > {COUNT}")
def remove_count(spark, folder):
    return selection.remove_particles(wrapped(spark, folder), UNIT, REGIONS, "SPHERE", count=COUNT, seed=SEED).select("id")


CELLS = ", ".join(f"floor(r{a} / 0.1)::INT AS {c}" for a, c in zip(AXES, cells.CELL))


@query(sql=f"{WRAPPED} SELECT row_number() OVER (ORDER BY floor(rz / 0.1), floor(ry / 0.1), floor(rx / 0.1), id) - 1 AS id, rx, ry, rz FROM w")
def compact_particle_ids(spark, folder):
    return ranking.compact_ids(wrapped(spark, folder), UNIT).select("id", "rx", "ry", "rz")


@query(sql=f"{WRAPPED} SELECT row_number() OVER (ORDER BY NOT {SQL_SPHERE}, id) - 1 AS id, rx, ry, rz FROM w")
def track_region_particles(spark, folder):
    return ranking.track_regions(wrapped(spark, folder), UNIT, REGIONS, ["inner"], ["SPHERE"])[0].select("id", "rx", "ry", "rz")


@query(sql=f"{WRAPPED} SELECT row_number() OVER (ORDER BY CASE WHEN {SQL_SPHERE} THEN 0 WHEN {SQL_BOX} THEN 1 ELSE 2 END, id) - 1 AS id, rx, ry, rz FROM w")
def track_region_particles_multiple(spark, folder):
    return ranking.track_regions(wrapped(spark, folder), UNIT, REGIONS, ["inner", "right"], ["SPHERE", "BOX"])[0].select("id", "rx", "ry", "rz")


@query(
    sql="""WITH g AS (SELECT i, j, k, l FROM (SELECT unnest(generate_series(-1, 11)) AS i), (SELECT unnest(generate_series(-1, 11)) AS j), (SELECT unnest(generate_series(-1, 11)) AS k), (SELECT unnest([0, 1]) AS l)),
a AS (SELECT l AS type, (i + l * 0.5) * 3.0::DOUBLE AS rx, (j + l * 0.5) * 3.0::DOUBLE AS ry, (k + l * 0.5) * 3.0::DOUBLE AS rz FROM g)
SELECT type, rx, ry, rz FROM a WHERE rx >= 0 AND rx < 30 AND ry >= 0 AND ry < 30 AND rz >= 0 AND rz < 30"""
)
def lattice_bcc(spark, folder):
    return particles.lattice(spark, EVENTS, "BCC", [0, 1], (3.0, 3.0, 3.0)).select("type", "rx", "ry", "rz")


@query(sql=f"{WITH}, m AS (SELECT max(id) + 1 AS block FROM p), c AS (SELECT unnest(generate_series(0, 5)) AS c) SELECT id + c * block AS id, rx + c % 2 AS rx, ry + (c // 2) % 3 AS ry, rz FROM p, c, m")
def replicate_domain(spark, folder):
    return particles.replicate(emb(spark, folder), UNIT, (2, 3, 1))[0].select("id", "rx", "ry", "rz")


@query(sql=f"{WITH} SELECT id, rx, ry, rz, vx FROM p UNION ALL SELECT (SELECT max(id) FROM p) + k, x, x, x, v FROM (VALUES (1, 0.5::DOUBLE, 0.0::DOUBLE), (2, 0.25::DOUBLE, 7.0::DOUBLE)) t(k, x, v)")
def grid_insert_particles(spark, folder):
    new = [{"pos": (0.5, 0.5, 0.5), "type": "A"}, {"pos": (9.0, 0.0, 0.0), "type": 1}, {"pos": (0.25, 0.25, 0.25), "vel": (7.0, 0.0, 0.0), "type": "B"}]
    return particles.insert(emb(spark, folder), UNIT, new, {"A": 0, "B": 1}).select("id", "rx", "ry", "rz", "vx")


HISTOGRAM = f"""{EV}, v AS (SELECT 'rx' AS plot, rx AS v FROM p UNION ALL SELECT 'rz', rz FROM p UNION ALL SELECT 'vx', vx FROM p),
e2 AS (SELECT plot, min(v) AS lo, max(v) AS hi FROM v WHERE isfinite(v) GROUP BY plot),
c AS (SELECT plot, least(floor(64 * (v - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END), 63)::INT AS bin, count(*) AS n FROM v JOIN e2 USING (plot) WHERE isfinite(v) GROUP BY ALL),
b AS (SELECT plot, lo, hi, unnest(generate_series(0, 63))::INT AS bin FROM e2)
SELECT plot, bin, round(lo + (bin + 0.5) * ((hi - lo) / 64), 9) AS x, coalesce(n, 0)::DOUBLE AS y FROM b LEFT JOIN c USING (plot, bin)"""


@query(sql=HISTOGRAM)
def grid_particle_histogram(spark, folder):
    return rounded(analytics.histogram(evt(spark, folder), ["rx", "rz", "vx"], 64), ["x"], 9)


@query(sql=f"WITH h AS ({HISTOGRAM}), r AS (SELECT *, sum(x * y) OVER (PARTITION BY plot ORDER BY bin) AS run, sum(x * y) OVER (PARTITION BY plot) AS total FROM h) SELECT plot, arg_min(bin, (abs(run - total / 2), bin)) AS bin FROM r GROUP BY plot")
def print_histogram(spark, folder):
    """The value-weighted median bin that the printed histogram marks."""
    return analytics.weighted_median_bin(analytics.histogram(evt(spark, folder), ["rx", "rz", "vx"], 64))


SLICES = f"""{EV}, m AS (SELECT min(rx - 15) AS lo, max(rx - 15) AS hi FROM p), n AS (SELECT lo, greatest(1, ceil((hi - lo) / 2))::INT AS c FROM m),
s AS (SELECT least(trunc((rx - 15 - lo) / 2), c - 1)::INT AS bin, vx FROM p, n WHERE rx IS NOT NULL AND ry IS NOT NULL AND rz IS NOT NULL), g AS (SELECT bin, count(*) AS n, sum(vx) AS v FROM s GROUP BY bin), b AS (SELECT lo, unnest(generate_series(0, c - 1))::INT AS bin FROM n)
SELECT 'vx' AS plot, bin, round(lo + (bin + 0.5) * 2, 9) AS x, round(coalesce(v / n, 0), 6) AS y FROM b LEFT JOIN g USING (bin)"""


@query(sql=SLICES)
def grid_particle_slicing(spark, folder):
    return rounded(rounded(analytics.slicing(evt(spark, folder), EVENTS, ["vx"], 2.0, average=["vx"]), ["x"], 9), ["y"])


IMAGES = """i AS (SELECT unnest([-2, -1, 0, 1, 2]) AS ix), j AS (SELECT unnest([-2, -1, 0, 1, 2]) AS iy), k AS (SELECT unnest([-2, -1, 0, 1, 2]) AS iz)"""


@query(
    sql=f"""{WRAPPED}, {IMAGES}, m AS (SELECT min(rx - 0.5) AS lo, max(rx - 0.5) AS hi FROM w), n AS (SELECT lo, greatest(1, ceil((hi - lo) / 0.1))::INT AS c FROM m),
s AS (SELECT rx - 0.5 + ix AS x, ry - 0.5 + iy AS y, rz - 0.5 + iz AS z FROM w, i, j, k),
g AS (SELECT greatest(least(trunc((x - lo) / 0.1), c - 1), 0)::INT AS bin, count(*) AS n FROM s, n WHERE y * y + z * z <= 3 GROUP BY ALL)
SELECT bin, n FROM g"""
)
def slicing_images(spark, folder):
    """Slicing with the periodic images inside the disk."""
    p = wrapped(spark, folder).withColumn("one", F.lit(1.0))
    return analytics.slicing(p, UNIT, ["one"], 0.1).where("y > 0").select("bin", F.col("y").cast("long").alias("n"))


@query(sql=f"{WRAPPED} SELECT {CELLS}, count(*) AS n FROM w GROUP BY ALL")
def cell_density(spark, folder):
    return analytics.cell_counts(wrapped(spark, folder), UNIT)


@query(sql=f"{WRAPPED}, c AS (SELECT {CELLS}, count(*) AS n FROM w GROUP BY ALL) SELECT 1000::BIGINT AS cells, 1000 - count(*) AS empty_cells, sum(n)::BIGINT AS particles, CASE WHEN count(*) < 1000 THEN 0 ELSE min(n) END AS min_particles, sum(n) / 1000 AS avg_particles, max(n) AS max_particles, 0::BIGINT AS outside FROM c")
def grid_stats(spark, folder):
    return analytics.grid_stats(wrapped(spark, folder), UNIT)


@query(sql=f"{WRAPPED}, c AS (SELECT {CELLS}, count(*) / {UNIT.cell_size**3!r} AS d FROM w GROUP BY ALL) SELECT ci, cj, ck, round(1e-6 * d * d * d + 1e-3 * d * d + d + 5, 3) AS cost FROM c")
def simple_cost_model(spark, folder):
    return rounded(analytics.cell_costs(wrapped(spark, folder), UNIT, (1e-6, 1e-3, 1.0, 5.0)), ["cost"], 3)


@query(sql=f"{WITH} SELECT round(sum(fx), 6) AS fx, round(sum(fy), 6) AS fy, round(sum(fz), 6) AS fz, round(sqrt(sum(fx) ** 2 + sum(fy) ** 2 + sum(fz) ** 2), 6) AS norm_sum, round(sum({norm_sql('f')}), 6) AS sum_norm FROM p")
def debug_total_force(spark, folder):
    return rounded(analytics.total_force(emb(spark, folder)), ["fx", "fy", "fz", "norm_sum", "sum_norm"])


@query(sql=f"{WITH} SELECT count(*) FILTER (vx * vx + vy * vy + vz * vz >= 0.01) AS n, count(*) FILTER (vx * vx + vy * vy + vz * vz >= 0.01) > 0 AS result FROM p")
def particle_displ_over(spark, folder):
    """How many particles move by 0.1 and more when each goes by its velocity; the displacement is exact only up to rounding."""
    p = emb(spark, folder)
    far = p.withColumns({f"r{a}": F.col(f"v{a}") for a in AXES})
    return analytics.displaced(far, p.select("id", *(F.lit(0.0).alias(f"r{a}") for a in AXES)), 0.1)


# Pairs by brute force over all images of the unit cube.
PAIRS = f"""i AS (SELECT unnest([-1, 0, 1]) AS ix), j AS (SELECT unnest([-1, 0, 1]) AS iy), k AS (SELECT unnest([-1, 0, 1]) AS iz),
nb AS (SELECT p.id AS a, q.id AS b, q.rx + ix - p.rx AS dx, q.ry + iy - p.ry AS dy, q.rz + iz - p.rz AS dz, p.type AS ta, q.type AS tb, q.vx AS nb_vx FROM w p, w q, i, j, k),
n2 AS (SELECT *, dx * dx + dy * dy + dz * dz AS d2 FROM nb), n AS (SELECT * FROM n2 WHERE d2 > 0 AND d2 <= {RCUT * RCUT!r})"""


@query(sql=f"{WRAPPED}, {PAIRS} SELECT a, b, round(dx, 9) AS dx, round(dy, 9) AS dy, round(dz, 9) AS dz, round(d2, 9) AS d2 FROM n")
def chunk_neighbors(spark, folder):
    """The periodic distance join: pairs with 0 < d <= 0.1."""
    return rounded(neighbors.neighbors(wrapped(spark, folder), UNIT, RCUT), ["dx", "dy", "dz", "d2"], 9)


@query(sql=f"{WRAPPED}, {PAIRS} SELECT a, b, round(d2, 9) AS d2 FROM n WHERE a > b")
def chunk_neighbors_half(spark, folder):
    return rounded(neighbors.neighbors(wrapped(spark, folder), UNIT, RCUT, half=True).select("a", "b", "d2"), ["d2"], 9)


@query(sql=f"{WRAPPED}, {PAIRS.replace('d2 > 0 AND', '(d2 > 0 OR a <> b) AND')} SELECT a, b, round(d2, 9) AS d2 FROM n WHERE a < b")
def compute_primary_neighbors(spark, folder):
    return rounded(neighbors.primary(wrapped(spark, folder), UNIT, RCUT).select("a", "b", "d2"), ["d2"], 9)


@query(sql=f"{WRAPPED}, {PAIRS} SELECT b AS a, a AS b FROM n WHERE a < b")
def compute_dual_neighbors(spark, folder):
    return neighbors.dual(neighbors.primary(wrapped(spark, folder), UNIT, RCUT)).select("a", "b")


@query(sql=f"{WRAPPED}, {PAIRS}, e AS (SELECT w.id, count(n.a) AS c FROM w LEFT JOIN n ON w.id = n.a GROUP BY w.id), d AS (SELECT min(sqrt(d2)) AS lo, max(sqrt(d2)) AS hi FROM n) SELECT sum(c)::BIGINT AS pairs, round(avg(c), 9) AS nbh_avg, min(c) AS nbh_min, max(c) AS nbh_max, round(min(lo), 9) AS dist_min, round(max(hi), 9) AS dist_max FROM e, d")
def chunk_neighbors_stats(spark, folder):
    p = wrapped(spark, folder)
    return rounded(neighbors.neighbor_stats(p, neighbors.neighbors(p, UNIT, RCUT)), ["nbh_avg", "dist_min", "dist_max"], 9)


@query(sql=f"{WRAPPED}, {PAIRS}, s AS (SELECT a AS id, sum((1 - 5 * sqrt(d2)) * nb_vx) / CASE WHEN sum(1 - 5 * sqrt(d2)) > 0 THEN sum(1 - 5 * sqrt(d2)) ELSE 1 END AS m FROM n GROUP BY a) SELECT w.id, round(coalesce(m, 0), 6) AS mean_vx FROM w LEFT JOIN s USING (id)")
def average_neighbors_scalar(spark, folder):
    p = wrapped(spark, folder)
    pairs = neighbors.neighbors(p, UNIT, RCUT, keep=("vx",))
    return rounded(neighbors.average_neighbors(p, pairs, "vx", "mean_vx", RCUT, (1.0, -5.0)).select("id", "mean_vx"), ["mean_vx"])


@query(sql=f"{WRAPPED}, {PAIRS}, keys AS ({uniform_key_sql('(SELECT id FROM w)', 'id', SEED)}), gone AS (SELECT DISTINCT a AS id FROM n JOIN keys x ON a = x.id JOIN keys y ON b = y.id WHERE d2 < 0.0025 AND a <> b AND (y.u, b) < (x.u, a)) SELECT id FROM w WHERE id NOT IN (SELECT id FROM gone)")
def remove_close_particles(spark, folder):
    return selection.remove_close(wrapped(spark, folder), UNIT, 0.05, SEED).select("id")


@query(sql=f"{WRAPPED}, {PAIRS}, s AS (SELECT a AS id, " + ", ".join(f"sum(1e-6 * x.mass * y.mass / d2 / sqrt(d2) * d{a}) AS s{a}" for a in AXES) + " FROM n JOIN particle_types x ON ta = x.type JOIN particle_types y ON tb = y.type GROUP BY a) SELECT w.id, " + ", ".join(f"round(coalesce(s{a}, 0), 4) AS f{a}" for a in AXES) + " FROM w LEFT JOIN s USING (id)")
def gravitational_force(spark, folder):
    p = transform.zero_force(wrapped(spark, folder))
    return rounded(neighbors.gravity(p, UNIT, table(spark, folder, "particle_types"), 1e-6, RCUT).select("id", "fx", "fy", "fz"), ["fx", "fy", "fz"], 4)


@query()
def snap_force_generic(spark, folder):
    """The spectral potential with coefficients that fall off with their order."""
    p = transform.zero_force(wrapped(spark, folder)).withColumn("type", F.lit(0))
    count = len(snap.triples(4)) + 1
    potential = snap.Snap(4, 0.1, (0.5,), (1.0,), (tuple(1.0 / (1 + k) for k in range(count)),))
    return rounded(snap.snap_force(p, UNIT, potential).select("id", "ep", "fx", "fy", "fz"), ["ep", "fx", "fy", "fz"])


@query(sql=f"{WRAPPED}, i AS (SELECT unnest([-1, 0, 1]) AS ix), j AS (SELECT unnest([-1, 0, 1]) AS iy), k AS (SELECT unnest([-1, 0, 1]) AS iz) SELECT ix, iy, iz, round(sqrt((q.rx + ix - p.rx) ** 2 + (q.ry + iy - p.ry) ** 2 + (q.rz + iz - p.rz) ** 2), 9) AS distance FROM w p, w q, i, j, k WHERE p.id = 1 AND q.id = 2")
def debug_particle_distance(spark, folder):
    return rounded(neighbors.image_distances(wrapped(spark, folder), UNIT, 1, 2).select("ix", "iy", "iz", "distance"), ["distance"], 9)


SUBDIV = 3
SPLAT = 0.05
SIZE = UNIT.cell_size / SUBDIV


def _overlap(a: str) -> str:
    return f"(least(r{a} + {SPLAT / 2!r}, (k{a} + 1) * {SIZE!r}) - greatest(r{a} - {SPLAT / 2!r}, k{a} * {SIZE!r})) / {SPLAT!r}"


SPREAD = f"o AS (SELECT unnest([-2, -1, 0, 1, 2]) AS o), " + ", ".join(f"s{a} AS (SELECT {'*' if i == 0 else 's' + AXES[i - 1] + '.*'}, floor(r{a} / {SIZE!r})::BIGINT + o AS k{a} FROM {'w' if i == 0 else 's' + AXES[i - 1]}, o)" for i, a in enumerate(AXES))
SPLATS = f"""{SPREAD.replace('SELECT *,', 'SELECT w.*,')}, sw AS (SELECT *, {_overlap('x')} AS wx, {_overlap('y')} AS wy, {_overlap('z')} AS wz FROM sz),
sums AS (SELECT (kx + 30) % 30 AS kx, (ky + 30) % 30 AS ky, (kz + 30) % 30 AS kz, sum(wx * wy * wz) AS count, sum(wx * wy * wz * vx) AS vx FROM sw WHERE wx > 0 AND wy > 0 AND wz > 0 GROUP BY ALL)"""
SUBKEYS = ", ".join(f"(k{a} // 3)::INT AS c{n}, (k{a} % 3)::INT AS s{n}" for a, n in zip(AXES, "ijk"))


def projected(spark, folder):
    return cells.project(wrapped(spark, folder), UNIT, SPLAT, SUBDIV, {"count": F.lit(1.0), "vx": F.col("vx")})


@query(sql=f"{WRAPPED}, {SPLATS} SELECT {SUBKEYS}, round(count, 6) AS count, round(vx, 6) AS vx FROM sums WHERE count > 1e-6")
def particle_cell_projection(spark, folder):
    return rounded(projected(spark, folder).where(F.col("count") > 1e-6), ["count", "vx"])


CENTRES = ", ".join(f"(c{n} * 0.1 + (s{n} + 0.5) * {UNIT.cell_size / 2!r}) AS r{a}" for a, n in zip(AXES, "ijk"))
SUBCELLS = "g AS (SELECT " + ", ".join(f"{n}::INT AS {n}" for n in cells.KEY) + " FROM " + ", ".join(f"(SELECT unnest(generate_series(0, {9 if n[0] == 'c' else 1})) AS {n})" for n in cells.KEY) + ")"


@query(sql=f"WITH {SUBCELLS}, c AS (SELECT *, {CENTRES} FROM g) SELECT {KEY6}, CASE WHEN {SQL_SPHERE} THEN 2.5 ELSE 0 END::DOUBLE AS mask FROM c")
def set_cell_values(spark, folder):
    return cells.set_cell_values(cells.all_sub_cells(spark, UNIT, 2), UNIT, 2, "mask", 2.5, REGIONS, "SPHERE").select(*cells.KEY, "mask")


@query(sql=f"{WRAPPED}, f AS (SELECT *, floor(rx / 0.1) AS cell FROM w), u AS (SELECT *, cell * 0.1 - vx AS x, 0 - vy AS y, 1 - vz AS z FROM f), m AS (SELECT *, sqrt(x * x + y * y + z * z) AS size FROM u) SELECT id, round(fx + 0.5 * x * size, 6) AS fx, round(fy + 0.5 * y * size, 6) AS fy, round(fz + 0.5 * z * size, 6) AS fz FROM m")
def fluid_friction(spark, folder):
    """Drag towards a flow held by the cells, looked up by equi-join."""
    flow = cells.all_sub_cells(spark, UNIT).withColumns({"c": F.lit(0.5), "ux": F.col("ci") * 0.1, "uy": F.lit(0.0), "uz": F.lit(1.0)})
    at = cells.lookup(wrapped(spark, folder), flow, UNIT, 1, ["c", "ux", "uy", "uz"])
    out = transform.fluid_friction(at, F.col("c"), (F.col("ux"), F.col("uy"), F.col("uz")))
    return rounded(out.select("id", "fx", "fy", "fz"), ["fx", "fy", "fz"])


NEAR = f"""{WRAPPED}, c AS (SELECT {CELLS}, count(*) AS n FROM w GROUP BY ALL), on_ AS (SELECT *, ck * 100 + cj * 10 + ci AS u FROM c WHERE n >= 2),
e AS (SELECT p.u, q.u AS v FROM on_ p, on_ q WHERE p.u <> q.u AND (abs(p.ci - q.ci) <= 1 OR abs(p.ci - q.ci) = 9) AND (abs(p.cj - q.cj) <= 1 OR abs(p.cj - q.cj) = 9) AND (abs(p.ck - q.ck) <= 1 OR abs(p.ck - q.ck) = 9))"""


@query(sql=f"WITH RECURSIVE {NEAR.removeprefix('WITH ')}, r(u, label) AS (SELECT u, u FROM on_ UNION SELECT e.v, label FROM r JOIN e USING (u)), l AS (SELECT u, min(label) AS label FROM r GROUP BY u), s AS (SELECT label, count(*) AS c FROM l GROUP BY label) SELECT c AS count, count(*) AS components FROM s GROUP BY c")
def cc_sizes(spark, folder):
    """How many components of cells with two particles and more have each size."""
    c = analytics.cell_counts(wrapped(spark, folder), UNIT).withColumns({s: F.lit(0) for s in cells.SUB})
    labelled = components.label_components(c, UNIT, 1, "n", 2)
    sizes = labelled.where("cc_label >= 0").groupBy("cc_label").count()
    return sizes.groupBy("count").agg(F.count("*").alias("components"))


def ball(spark):
    return mesh.triangles(spark, *mesh.sphere_mesh(0.3, 8, 12, (0.5, 0.5, 0.5)))


WALL = ([(0.5, -1.0, -1.0), (0.5, 3.0, -1.0), (0.5, -1.0, 3.0)], [(0, 1, 2)])


@query(sql=f"{WRAPPED}, {PAIRS} SELECT n.a, n.b FROM n JOIN w ON n.a = w.id WHERE NOT (least(rx, rx + dx) <= 0.5 AND greatest(rx, rx + dx) >= 0.5 AND dx <> 0)")
def chunk_neighbors_no_surface_crossing(spark, folder):
    """Neighbour pairs that a wall at x = 0.5 doesn't part."""
    p = wrapped(spark, folder)
    pairs = neighbors.neighbors(p, UNIT, RCUT)
    return mesh.without_crossings(p, pairs, mesh.triangles(spark, *WALL), 0.25).select("a", "b")


@query(sql="SELECT step::INT AS step, 1 + 0.01 * step AS m11, 1::DOUBLE AS m22 FROM (SELECT unnest(generate_series(1, 10)) AS step)")
def xform_constant_strain_rate(spark, folder):
    d, rows = UNIT, []
    for step in range(1, 11):
        d, _ = deform.strain_step(d, "uniaxial", 0.01, 1.0, step)
        rows.append((step, round(d.xform[0], 12), d.xform[4]))
    return spark.createDataFrame(rows, "step int, m11 double, m22 double")


@query(sql=f"{WITH} SELECT id, {WRAP}, " + ", ".join(f"floor((((r{a} % 1) + 1) % 1) / 0.1)::INT AS {c}" for a, c in zip(AXES, cells.CELL)) + " FROM p")
def move_particles(spark, folder):
    return transform.move_particles(emb(spark, folder), UNIT)[0].select("id", "rx", "ry", "rz", *cells.CELL)


@query(sql=f"{WRAPPED}, i AS (SELECT unnest([-1, 0, 1]) AS ix), j AS (SELECT unnest([-1, 0, 1]) AS iy), k AS (SELECT unnest([-1, 0, 1]) AS iz) SELECT id, ix, iy, iz, (ix <> 0 OR iy <> 0 OR iz <> 0) AS is_ghost FROM w, i, j, k WHERE rx + ix >= -0.1 AND rx + ix < 1.1 AND ry + iy >= -0.1 AND ry + iy < 1.1 AND rz + iz >= -0.1 AND rz + iz < 1.1")
def ghost_update_all(spark, folder):
    """Images of the particles within a cell of the box."""
    return partitioning.periodic_images(wrapped(spark, folder), UNIT, 0.1).select("id", "ix", "iy", "iz", "is_ghost")


@query(sql=f"{WRAPPED}, i AS (SELECT unnest([-1, 0, 1]) AS ix), j AS (SELECT unnest([-1, 0, 1]) AS iy), k AS (SELECT unnest([-1, 0, 1]) AS iz) SELECT id, round(sum(fx), 9) AS fx FROM w, i, j, k WHERE rx + ix >= -0.1 AND rx + ix < 1.1 AND ry + iy >= -0.1 AND ry + iy < 1.1 AND rz + iz >= -0.1 AND rz + iz < 1.1 GROUP BY id")
def update_force_from_ghost(spark, folder):
    images = partitioning.periodic_images(wrapped(spark, folder), UNIT, 0.1)
    return rounded(partitioning.sum_from_images(images, ["fx"]), ["fx"], 9)


@query(sql="SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY ALL")
def load_balance_partition(spark, folder):
    """Rows range-partitioned by z-order of their cells: the answer doesn't depend on it."""
    d = Domain.cube(51.0, 51, (False, False, False))
    li = table(spark, folder, "lineitem").select("l_returnflag", F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("rx"), (F.col("l_extendedprice") / 2100).alias("ry"), (F.col("l_discount") * 500).alias("rz"))
    return partitioning.partition_by_cells(li, d, 8).groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"))


@query(sql=f"WITH p AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS id, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS type, l_quantity AS rx FROM lineitem) SELECT type, count(*) AS n, min(id) AS first_id, max(id) AS last_id, max(rx) AS max_rx FROM p GROUP BY type")
def lineitem_particles(spark, folder):
    """Dense ids of a large table by range partitions, not in one window."""
    p = particles.from_lineitem(table(spark, folder, "lineitem"))
    return p.groupBy("type").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max("rx").alias("max_rx"))


@query(sql=f"{WRAPPED} SELECT id, type, rx, vx FROM w WHERE id IN (3, 5, 8)")
def debug_particle(spark, folder):
    return checks.particles_by_id(wrapped(spark, folder), [3, 5, 8]).select("id", "type", "rx", "vx")


@query(sql=f"{WRAPPED} SELECT {', '.join(c for c in ALL if c[0] != 'f')}, 0::DOUBLE AS fx, 0::DOUBLE AS fy, 0::DOUBLE AS fz FROM w")
def dump_round_trip(spark, folder):
    """write_dump and read_dump."""
    path = Scratch(spark, "dump").root
    files.write_dump(wrapped(spark, folder), UNIT, path, 3, 0.5)
    return files.read_dump(spark, path)[0].select(*ALL)


@query(sql="WITH g AS (SELECT " + ", ".join(f"{n}::INT AS {n}" for n in cells.KEY) + " FROM " + ", ".join(f"(SELECT unnest(generate_series(0, {2 if n[0] == 'c' else 1})) AS {n})" for n in cells.KEY) + f") SELECT {KEY6}, ((ck * 2 + sk) * 36 + (cj * 2 + sj) * 6 + ci * 2 + si)::DOUBLE AS mask FROM g")
def read_cell_values(spark, folder):
    """A legacy structured-points file read back: values count up in Fortran order."""
    path = f"{Scratch(spark, 'points').root}/points.vtk"
    head = "# vtk DataFile Version 3.0\nmask\nASCII\nDATASET STRUCTURED_POINTS\nDIMENSIONS 6 6 6\nORIGIN 0 0 0\nSPACING 1 1 1\nPOINT_DATA 216\nSCALARS mask double 1\nLOOKUP_TABLE default\n"
    files.text(spark, path, head + "\n".join(" ".join(str(v) for v in range(s, s + 8)) for s in range(0, 216, 8)) + "\n")
    return files.read_cell_values(spark, path, Domain.cube(3.0, 3), 2, "mask")


@query()
def verlet_steps(spark, folder):
    """Ten steps of the loop: pushes, neighbour lists with a skin, forces."""
    p = transform.zero_force(wrapped(spark, folder)).withColumns({f"v{a}": F.col(f"v{a}") * 0.01 for a in AXES})
    close = selection.remove_close(p, UNIT, 0.04, SEED)
    end = run(close, UNIT, Verlet(dt=1e-4, rcut=0.08, skin=0.02, force=lambda df, pairs: neighbors.pair_force(df, pairs, -24.0 * (2.0 * F.pow(0.04 / F.sqrt("d2"), F.lit(12.0)) - F.pow(0.04 / F.sqrt("d2"), F.lit(6.0))) / F.sqrt("d2") * 1e-3)), steps=10)
    return stats(end)
