"""Queries of operators as stages of a pipeline, named by the stage."""

from __future__ import annotations


from pyspark.sql import functions as F

from cellframe.domain import AXES, Domain
from cellframe.functions.keys import uniform_key_sql
from cellframe.operators import cells
from cellframe.plans.catalogue import query
from cellframe.plans.checked_queries import COMPONENTS
from cellframe.plans.particle_queries import CELLS, EVENTS, HISTOGRAM, PAIRS, RCUT, SPLATS, SUBDIV, UNIT, WITH, WRAPPED, emb, evt, norm_sql, projected, rounded, wrapped
from cellframe.plans.pipeline import State, run_pipeline
from cellframe.runtime import Scratch
from cellframe.sources import files


def begin(spark, folder, **more) -> State:
    return State(wrapped(spark, folder), UNIT, **more)


def one_row(first, *others):
    """The columns of several tables of one row side by side."""
    for o in others:
        first = first.select("*", *(F.lit(v).cast(t).alias(n) for (n, t), v in zip(o.dtypes, o.first())))
    return first


# the domain


def domain_rows(spark, domains):
    return spark.createDataFrame([(i, *d.grid_dims, round(d.cell_size, 9), *(round(x, 9) for x in d.bmax)) for i, d in enumerate(domains)], "n int, nx int, ny int, nz int, cell double, hx double, hy double, hz double")


@query(sql="SELECT n::INT AS n, (10 * (n + 1))::INT AS nx, 10 AS ny, 5 AS nz, 2::DOUBLE AS cell, (20 * (n + 1))::DOUBLE AS hx, 20::DOUBLE AS hy, 10::DOUBLE AS hz FROM (SELECT unnest(generate_series(0, 4)) AS n)")
def domain(spark, folder):
    """Bounds and cell size give the cells."""
    return domain_rows(spark, [run_pipeline(begin(spark, folder), [{"domain": {"bmin": (0.0, 0.0, 0.0), "bmax": (20.0 * (n + 1), 20.0, 10.0), "cell_size": 2.0}}]).domain for n in range(5)])


@query(sql="SELECT n::INT AS n, (10 // (n + 1))::INT AS nx, (10 // (n + 1))::INT AS ny, (10 // (n + 1))::INT AS nz, round(1 / (10 // (n + 1)), 9)::DOUBLE AS cell, 1::DOUBLE AS hx, 1::DOUBLE AS hy, 1::DOUBLE AS hz FROM (SELECT unnest(generate_series(0, 4)) AS n)")
def domain_update(spark, folder):
    """A wished cell size, then cells that fill the bounds."""
    wished = [{"domain_override": {"cell_size": 0.1 * (n + 1)}} for n in range(5)]
    return domain_rows(spark, [run_pipeline(begin(spark, folder), [w, "domain_update"]).domain for w in wished])


@query(sql=f"{WITH} SELECT id, ((rx % 2) + 2) % 2 AS rx, ((ry % 2) + 2) % 2 AS ry, rz FROM p WHERE rz >= 0 AND rz < 2")
def domain_override(spark, folder):
    """Other bounds and a closed axis: what wraps and what leaves follows them."""
    s = run_pipeline(State(emb(spark, folder), UNIT), [{"domain_override": {"bmax": (2.0, 2.0, 2.0), "grid_dims": (20, 20, 20), "periodic": (True, True, False)}}, "move_particles"])
    return s.particles.select("id", "rx", "ry", "rz")


@query(sql="SELECT n::INT AS n, 1 + n * 0.5::DOUBLE AS m11, n * 0.25::DOUBLE AS m12, round(1 / (1 + n * 0.5), 9)::DOUBLE AS i11, round(-n * 0.25 / (1 + n * 0.5), 9)::DOUBLE AS i12 FROM (SELECT unnest(generate_series(0, 6)) AS n)")
def domain_extract_xform(spark, folder):
    """A deformation and its inverse, kept by backup_xform too."""
    rows = []
    for n in range(7):
        m = (1 + n * 0.5, n * 0.25, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
        bag = run_pipeline(begin(spark, folder), [{"domain_set_xform": {"xform": m}}, "domain_extract_xform", "backup_xform", {"domain_set_xform": {"xform": (1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0)}}]).bag
        rows.append((n, float(bag["backup_xform"][0]), float(bag["xform"][1]), round(bag["inv_xform"][0], 9), round(bag["inv_xform"][1], 9)))
    return spark.createDataFrame(rows, "n int, m11 double, m12 double, i11 double, i12 double")


# blocks, owners and moves


def counted_blocks(spark, folder, stage: str):
    s = run_pipeline(begin(spark, folder), [stage, "cell_owner_rank", "migrate_cell_particles"])
    owned = s.domain.with_cells(s.particles).join(s.bag["cell_owner"], cells.CELL)
    per = s.bag["cell_owner"].groupBy("owner").count().agg(F.count("owner").alias("blocks"), F.sum("count").alias("cells"), F.count(F.when(F.col("owner").isNull(), 1)).alias("unowned"))
    return one_row(owned.agg(F.count("*").alias("particles"), F.round(F.sum("rx"), 6).alias("rx")), per)


BLOCKS = f"{WRAPPED} SELECT count(*) AS particles, round(sum(rx), 6) AS rx, 8::BIGINT AS blocks, 1000::BIGINT AS cells, 0::BIGINT AS unowned FROM w"


@query(sql=BLOCKS)
def load_balance_no_costs(spark, folder):
    """Even blocks own every cell once, and no particle is lost on the way to its owner."""
    return counted_blocks(spark, folder, "load_balance_no_costs")


@query(sql=BLOCKS)
def load_balance_random(spark, folder):
    """The same for random cuts."""
    return counted_blocks(spark, folder, "load_balance_random")


@query(sql=f"{WRAPPED}, c AS (SELECT {CELLS} FROM w) SELECT ci // 5 AS i, cj // 5 AS j, ck // 5 AS k, count(*) AS n FROM c GROUP BY ALL")
def init_rcb_grid(spark, folder):
    """Eight even blocks are the halves of each axis."""
    s = run_pipeline(begin(spark, folder), [{"init_rcb_grid": {"parts": 8}}, "cell_owner_rank"])
    starts = spark.createDataFrame([(i, *(x // 5 for x in lo)) for i, (lo, *_) in enumerate(s.bag["blocks"])], "owner int, i int, j int, k int")
    return s.domain.with_cells(s.particles).join(s.bag["cell_owner"], cells.CELL).join(starts, "owner").groupBy("i", "j", "k").agg(F.count("*").alias("n"))


@query(sql="SELECT a::INT AS a, b::INT AS b FROM (SELECT unnest(generate_series(0, 7)) AS a), (SELECT unnest(generate_series(0, 7)) AS b) WHERE a < b")
def subdomain_neighbors(spark, folder):
    """Of eight blocks of a periodic box all touch all."""
    s = run_pipeline(begin(spark, folder), ["init_rcb_grid", "subdomain_neighbors"])
    return spark.createDataFrame(s.bag["subdomain_neighbors"], "a int, b int")


@query(sql=f"{WRAPPED}, c AS (SELECT {CELLS}, count(*) AS n FROM w GROUP BY ALL), t AS (SELECT sum(n) AS total FROM c) SELECT sum(n)::BIGINT AS particles, true AS in_share FROM c, t")
def cpu_gpu_load_balance(spark, folder):
    """The fast side has the fullest cells, and no more than its share."""
    s = run_pipeline(begin(spark, folder), [{"cpu_gpu_load_balance": {"cpu_gpu_perf_ratio": 4.0, "gpu_cell_particles_threshold": 2}}])
    t = s.bag["cpu_gpu_partition"]
    fast, slow = F.min(F.when(F.col("fast"), F.col("n"))), F.max(F.when(~F.col("fast"), F.col("n")))
    ok = (F.coalesce(F.sum(F.when(F.col("fast"), F.col("n"))), F.lit(0)) <= 0.8 * F.sum("n")) & F.coalesce(slow < fast, F.lit(True))
    return t.agg(F.sum("n").alias("particles"), ok.alias("in_share"))


def with_payload(spark, folder, kind: str):
    p = wrapped(spark, folder)
    return p.withColumn("extra", F.slice(F.array(*(F.col(f"v{a}") if kind == "double" else F.col("id") + i for i, a in enumerate(AXES))), 1, (F.col("id") % 4).cast("int")))


DOUBLES = f"{WRAPPED} SELECT id, round(coalesce(list_sum([vx, vy, vz][1:(id % 4)::INT]), 0), 9) AS extra, (id % 4)::INT AS n FROM w"
INTEGERS = f"{WRAPPED} SELECT id, coalesce(list_sum([id, id + 1, id + 2][1:(id % 4)::INT]), 0)::BIGINT AS extra, (id % 4)::INT AS n FROM w"


def payload_rows(s: State, zero):
    total = F.aggregate("extra", zero, lambda a, x: a + x)
    return s.particles.select("id", (F.round(total, 9) if dict(s.particles.dtypes)["extra"] == "array<double>" else total).alias("extra"), F.size("extra").alias("n"))


@query(sql=DOUBLES)
def migrate_cell_particles_double(spark, folder):
    """Lists of doubles travel with their particles."""
    s = run_pipeline(State(with_payload(spark, folder, "double"), UNIT), ["init_rcb_grid", {"migrate_cell_particles_double": {"fields": ["extra"]}}, {"check_es_consistency_double": {"sizes": {"extra": F.col("id") % 4}}}])
    return payload_rows(s, F.lit(0.0))


@query(sql=INTEGERS)
def migrate_cell_particles_int(spark, folder):
    s = run_pipeline(State(with_payload(spark, folder, "int"), UNIT), ["init_rcb_grid", {"migrate_cell_particles_int": {"fields": ["extra"]}}])
    return payload_rows(s, F.lit(0).cast("long"))


@query(sql=DOUBLES)
def move_particles_double(spark, folder):
    s = run_pipeline(State(with_payload(spark, folder, "double"), UNIT), [{"shift_r": {"value": (3.0, 0.0, 0.0)}}, {"move_particles_double": {"fields": ["extra"]}}])
    return payload_rows(s, F.lit(0.0))


@query(sql=INTEGERS)
def move_particles_int(spark, folder):
    s = run_pipeline(State(with_payload(spark, folder, "int"), UNIT), [{"move_particles_int": {"fields": ["extra"]}}])
    return payload_rows(s, F.lit(0).cast("long"))


# images

SHIFTS = ", ".join(f"i{a} AS (SELECT unnest([-1, 0, 1]) AS i{a})" for a in AXES)
NEAR_FACES = " AND ".join(f"r{a} + i{a} >= -0.3 AND r{a} + i{a} < 1.3" for a in AXES)
GHOSTS = f"{WRAPPED}, {SHIFTS}, g AS (SELECT w.*, ix, iy, iz FROM w, ix, iy, iz WHERE {NEAR_FACES} AND (ix <> 0 OR iy <> 0 OR iz <> 0))"
PLACES = ", ".join(f"round(r{a} + i{a}, 9) AS r{a}" for a in AXES)


def ghosts(spark, folder, stage: str, **kw):
    return run_pipeline(begin(spark, folder), [{"ghost_comm_scheme": {"distance": 0.3}}, {stage: kw}]).ghosts


@query(sql=f"{GHOSTS} SELECT ix, iy, iz, count(*) AS n FROM g GROUP BY ALL")
def ghost_comm_scheme(spark, folder):
    """How many images each shift has."""
    s = run_pipeline(begin(spark, folder), [{"nbh_dist": {"rcut_max": 0.25, "rcut_inc": 0.05}}, "ghost_comm_scheme", "print_ghost_comm_scheme", "print_ghost_comm_stats"])
    lines = [line.split() for line in s.bag["print_ghost_comm_scheme"].splitlines()]
    return spark.createDataFrame([(*map(int, (x[1], x[2], x[3].rstrip(":"))), int(x[4])) for x in lines], "ix int, iy int, iz int, n long")


def _ghost_query(name: str, stage: str, carried: list[str], **kw):
    @query(name, sql=f"{GHOSTS} SELECT id, ix, iy, iz, {PLACES}{''.join(f', {c}' for c in carried)} FROM g")
    def run(spark, folder):
        g = ghosts(spark, folder, stage, **kw)
        return rounded(g.drop("is_ghost"), ["rx", "ry", "rz"], 9)


for _end in ("", "_no_gcv"):
    _ghost_query(f"ghost_update_all_no_fv{_end}", f"ghost_update_all_no_fv{_end}", ["type"])
    _ghost_query(f"ghost_update_r{_end}", f"ghost_update_r{_end}", [])
    _ghost_query(f"ghost_update_opt{_end}", f"ghost_update_opt{_end}", ["vx", "fz"], opt_fields=["vx", "f[z]"])
_ghost_query("ghost_update_all_no_gcv", "ghost_update_all_no_gcv", ["type", *(f"{p}{a}" for p in "vf" for a in AXES)])


def _back_query(name: str, fields: list[str], **kw):
    added = ", ".join(f"round({c} * (1 + coalesce(n, 0)), 9) AS {c}" for c in fields)

    @query(name, sql=f"{GHOSTS}, c AS (SELECT id, count(*) AS n FROM g GROUP BY id) SELECT w.id, {added} FROM w LEFT JOIN c USING (id)")
    def run(spark, folder):
        s = run_pipeline(begin(spark, folder), [{"ghost_update_all_no_gcv": {"distance": 0.3}}, {name: kw}, "grid_clear_ghosts"])
        assert s.ghosts is None
        return rounded(s.particles.select("id", *fields), fields, 9)


for _end in ("", "_no_gcv"):
    _back_query(f"update_opt_from_ghost{_end}", ["vx", "fz"], opt_fields=["vx", "fz"])
_back_query("update_force_from_ghost_no_gcv", ["fx", "fy", "fz"])


@query(sql=f"{GHOSTS} SELECT id, true AS is_ghost, {PLACES} FROM g UNION ALL SELECT id, false, {', '.join(f'round(r{a}, 9)' for a in AXES)} FROM w")
def debug_print_ghosts(spark, folder):
    s = run_pipeline(begin(spark, folder), [{"ghost_update_all": {"distance": 0.3}}, {"ghost_comm_scheme": {"distance": 0.3}}, "debug_print_ghosts"])
    return rounded(s.bag["debug_print_ghosts"].select("id", "is_ghost", "rx", "ry", "rz"), ["rx", "ry", "rz"], 9)


# neighbours and cells


@query(sql="SELECT n::INT AS n, round((0.4 + 0.1 * n) / 0.5, 9)::DOUBLE AS nbh_dist, round(0.05 * n / 2, 9)::DOUBLE AS max_displ, round((0.4 + 0.1 * n) / 0.5, 9)::DOUBLE AS ghost_dist FROM (SELECT unnest(generate_series(0, 5)) AS n)")
def nbh_dist(spark, folder):
    """Distances in a box stretched by two along x and pressed to a half along y."""
    rows = []
    for n in range(6):
        s = run_pipeline(begin(spark, folder), [{"domain_set_xform": {"xform": (2.0, 0, 0, 0, 0.5, 0, 0, 0, 1.0)}}, {"nbh_dist": {"rcut_max": 0.4, "rcut_inc": 0.1 * n}}])
        d = s.bag["nbh_dist"]
        rows.append((n, *(round(d[k], 9) for k in ("nbh_dist", "max_displ", "ghost_dist"))))
    return spark.createDataFrame(rows, "n int, nbh_dist double, max_displ double, ghost_dist double")


@query(sql=f"{WRAPPED}, c AS (SELECT {CELLS}, count(*) AS n FROM w GROUP BY ALL) SELECT ci, cj, ck, n, greatest(floor(cbrt(n / 0.3::DOUBLE)), 1)::INT AS side FROM c")
def rebuild_amr(spark, folder):
    """Into how many sub-cells an axis a cell is cut."""
    return run_pipeline(begin(spark, folder), [{"rebuild_amr": {"sub_grid_density": 0.3}}]).bag["amr"]


@query(sql="WITH o AS (SELECT i, j, k FROM (SELECT unnest(generate_series(-5, 5)) AS i), (SELECT unnest(generate_series(-5, 5)) AS j), (SELECT unnest(generate_series(-5, 5)) AS k)) SELECT i::INT AS i, j::INT AS j, k::INT AS k FROM o WHERE (greatest(0, abs(i) - 1) * 0.05) ** 2 + (greatest(0, abs(j) - 1) * 0.05) ** 2 + (greatest(0, abs(k) - 1) * 0.05) ** 2 < 0.12 * 0.12")
def amr_grid_pairs(spark, folder):
    """Offsets of sub-cells that come closer than a distance."""
    return spark.createDataFrame(run_pipeline(begin(spark, folder), [{"amr_grid_pairs": {"distance": 0.12, "subdiv": 2}}]).bag["amr_grid_pairs"], "i int, j int, k int")


@query(sql=f"{WRAPPED} SELECT count(*) AS particles, 0::BIGINT AS pairs, 1000::BIGINT AS cells FROM w")
def resize_grid_cell_values(spark, folder):
    """Empty neighbour lists and the cells of the grid, before anything is computed."""
    s = run_pipeline(begin(spark, folder), ["chunk_neighbors_init", "resize_grid_cell_values", "resize_particle_locks", "grid_memory_compact", "mpi_barrier"])
    return one_row(s.particles.agg(F.count("*").alias("particles")), s.pairs.agg(F.count("*").alias("pairs")), s.cell_values.agg(F.count("*").alias("cells")))


@query(sql=f"{WRAPPED} SELECT count(*) AS kept, 0::BIGINT AS cleared FROM w")
def copy_grid(spark, folder):
    """A copy taken, the grid cleared, and the copy put back."""
    s = run_pipeline(begin(spark, folder), ["copy_grid", "grid_clear"])
    cleared = s.particles.agg(F.count("*").alias("cleared"))
    return one_row(run_pipeline(s, ["copy_back_grid", "grid_passthru"]).particles.agg(F.count("*").alias("kept")), cleared)


@query(sql=f"{WRAPPED} SELECT id, (floor(rx / 0.1))::INT AS ci, round(rx, 9) AS rx FROM w WHERE rx < 0.5")
def backup_r_lt_move_data(spark, folder):
    """The rows of a backup whose particles are still there."""
    s = run_pipeline(begin(spark, folder), ["backup_r", "check_backup_r", {"particle_regions": {"HIGH": {"bounds": ((0.5, -9, -9), (9, 9, 9))}}}, {"remove_particles": {"region": "HIGH"}}, "backup_r_lt_move_data"])
    return s.bag["backup_r_lt"].select("id", "ci", F.round((F.col("ci") + F.col("qx") / F.lit(2.0**32)) * 0.1, 9).alias("rx"))


@query(sql=f"{WRAPPED} SELECT n::INT AS n, (SELECT count(*) FROM w WHERE abs(0.01 * n * vx) >= 0.015) > 0 AS result FROM (SELECT unnest(generate_series(1, 4)) AS n)")
def particle_displ_over_async_end(spark, folder):
    """Whether a particle went far enough, asked first and answered later."""
    rows = []
    for n in range(1, 5):
        s = run_pipeline(begin(spark, folder), ["backup_r", {"particle_displ_over": {"threshold": 0.015, "async_": True}}])
        s = run_pipeline(begin(spark, folder), ["backup_r"])
        moved = State(s.particles.withColumn("rx", F.col("rx") + 0.01 * n * F.col("vx")), UNIT, bag=s.bag)
        rows.append((n, run_pipeline(moved, [{"particle_displ_over": {"threshold": 0.015, "async_": True}}, "particle_displ_over_async_end"]).bag["result"]))
    return spark.createDataFrame(rows, "n int, result boolean")


# files and prints


@query(sql=f"{WRAPPED} SELECT id, round(rx, 9) AS rx, round(vx, 9) AS vx FROM w")
def write_paraview(spark, folder):
    """Point pieces, read back by the names that their index file lists."""
    path = Scratch(spark, "points").root
    run_pipeline(begin(spark, folder), [{"write_paraview": {"path": path, "fields": ["id", "vx"]}}])
    return rounded(files.read_points(spark, path, ["id", "vx"]).select("id", "rx", "vx"), ["rx", "vx"], 9)


@query(sql=f"{WRAPPED}, {SPLATS} SELECT kx::INT AS kx, ky::INT AS ky, kz::INT AS kz, round(count, 6) AS count FROM sums WHERE count > 1e-6")
def write_grid_vtk(spark, folder):
    """Cell values as image pieces, read back."""
    path = Scratch(spark, "image").root
    run_pipeline(begin(spark, folder, cell_values=projected(spark, folder)), [{"write_grid_vtk": {"path": path, "fields": ["count"], "grid_subdiv": SUBDIV}}])
    return rounded(files.read_grid(spark, path, "count").where(F.col("count") > 1e-6), ["count"])


@query(sql=f"SELECT label, count, round(center_x, 6) AS center_x, vx FROM ({COMPONENTS})")
def write_cc_table(spark, folder):
    path = Scratch(spark, "table").root
    s = begin(spark, folder, cell_values=Scratch(spark, "cells").save(projected(spark, folder), "v"))
    run_pipeline(s, [{"cc_label": {"field": "count", "threshold": 0.2, "grid_subdiv": SUBDIV, "count_threshold": 2, "sums": ["vx"]}}, {"write_cc_table": {"path": path, "extra": ("vx",)}}])
    read = spark.read.option("sep", ";").option("header", True).schema("label long, count long, center_x double, center_y double, center_z double, " + ", ".join(f"gyr_{p}{q} double" for p in AXES for q in AXES) + ", vx double").csv(path)
    return read.select("label", "count", F.round("center_x", 6).alias("center_x"), F.round("vx", 6).alias("vx"))


@query(sql=f"SELECT plot, x, y FROM ({HISTOGRAM})")
def write_plot1d(spark, folder):
    path = Scratch(spark, "plots").root
    run_pipeline(State(evt(spark, folder), EVENTS), [{"grid_particle_histogram": {"fields": ["rx", "rz", "vx"], "samples": 64}}, {"write_plot1d": {"path": path}}])
    read = spark.read.option("sep", ";").csv(path).select("plot", F.round(F.col("_c0").cast("double"), 9).alias("x"), F.col("_c1").cast("double").alias("y"))
    return read


@query(sql=f"SELECT plot, bin::INT AS bin, round(10 * abs(y) / max(abs(y)) OVER (PARTITION BY plot))::INT AS marks FROM ({HISTOGRAM}) WHERE plot = 'rx'")
def print_plot1d(spark, folder):
    """Bars of a plot, counted from the text that is printed."""
    s = run_pipeline(State(evt(spark, folder), EVENTS), [{"grid_particle_histogram": {"fields": ["rx"], "samples": 64}}, {"print_plot1d": {"plot_names": ["rx"]}}])
    return spark.createDataFrame([("rx", i, line.count("#")) for i, line in enumerate(s.bag["print_plot1d"].splitlines()[1:])], "plot string, bin int, marks int")


STATS = f"{WRAPPED}, s AS (SELECT count(*) AS n, sum(vx * vx + vy * vy + vz * vz) AS v2, max({norm_sql('v')}) AS v, max({norm_sql('f')}) AS f FROM w)"


@query(sql=f"{STATS} SELECT 0::BIGINT AS step, n, round(v2, 3) AS v2, round(v, 4) AS v, round(f, 4) AS f FROM s")
def print_simulation_stats(spark, folder):
    """The line that is printed for a step."""
    step, _, n, *x = run_pipeline(begin(spark, folder), ["print_simulation_stats"]).bag["print_simulation_stats"].split()
    return spark.createDataFrame([(int(step), int(n), round(float(x[0]), 3), round(float(x[1]), 4), round(float(x[2]), 4))], "step long, n long, v2 double, v double, f double")


@query(sql="SELECT * FROM (VALUES ('bounds'), ('bounds no ghost'), ('cell size'), ('dims'), ('dims no ghost'), ('expandable'), ('ghost layers'), ('grid'), ('mirror'), ('origin'), ('periodic'), ('volume'), ('xform')) t(name)")
def print_grid(spark, folder):
    """What print_domain and print_grid tell."""
    bag = run_pipeline(begin(spark, folder), ["print_domain", {"print_grid": {"ghost_layers": 1}}]).bag
    names = {line.split("=")[0].strip() for k in ("print_domain", "print_grid") for line in bag[k].splitlines()}
    return spark.createDataFrame([(n,) for n in sorted(names)], "name string")


# keyed draws, control values, rendering

DRAWS = f"SELECT (id // 20)::INT AS cycle, (id % 20)::INT AS sample, u FROM ({uniform_key_sql('(SELECT unnest(generate_series(0, 199)) AS id)', 'id', 0)})"


@query(sql=DRAWS)
def check_random_engine(spark, folder):
    return run_pipeline(begin(spark, folder), ["check_random_engine"]).bag["check_random_engine"]


@query(sql="SELECT n::INT AS n, n <= 3 AS go, printf('dump_%05d', n) AS file, n * 2.5::DOUBLE AS scaled FROM (SELECT unnest(generate_series(0, 5)) AS n)")
def before_timestep(spark, folder):
    """The loop's condition, a file's name and a scaled value at each step."""
    rows = []
    for n in range(6):
        bag = run_pipeline(begin(spark, folder, timestep=n), [{"before_timestep": {"end_at": 3}}, {"timestep_file": {"format": "dump_%05d"}}, {"value_scale": {"in_value": float(n), "scale": 2.5}}]).bag
        rows.append((n, bag["result"], bag["filename"], bag["out_value"]))
    return spark.createDataFrame(rows, "n int, go boolean, file string, scaled double")


@query(sql=f"{GHOSTS}, b AS (SELECT id, false AS is_ghost, rx AS x, type FROM w UNION ALL SELECT id, true, rx + ix, type FROM g) SELECT is_ghost, count(*) AS n, round(sum(x), 2) AS x, sum(type)::BIGINT AS types FROM b GROUP BY is_ghost")
def egl_particles_to_vertex_buffer(spark, folder):
    """Single-precision attributes of particles and images."""
    s = run_pipeline(begin(spark, folder), [{"ghost_update_all": {"distance": 0.3}}, {"egl_particles_to_vertex_buffer": {"vertex_attribs": {"rx": 0, "type": 3}}}])
    return s.bag["particles"].groupBy("is_ghost").agg(F.count("*").alias("n"), F.round(F.sum(F.col("a0").cast("double")), 2).alias("x"), F.sum("a3").alias("types"))


@query(sql=f"{WRAPPED} SELECT row_number() OVER (ORDER BY id) - 1 AS vertex FROM w")
def egl_particles_noghost_elements(spark, folder):
    s = run_pipeline(begin(spark, folder), [{"ghost_update_all": {"distance": 0.3}}, {"egl_particles_to_vertex_buffer": {"vertex_attribs": {"rx": 0}}}, "egl_particles_noghost_elements"])
    return s.bag["noghost_particles"]


@query(sql=f"{WRAPPED}, {PAIRS.replace('0.010000000000000002', repr(RCUT * RCUT))} SELECT a, b FROM n")
def numerical_scheme(spark, folder):
    """The batches of a step with a zero force and no time: the same pairs after it."""
    s = run_pipeline(begin(spark, folder), ["numerical_scheme", "chunk_neighbors"], {"compute_force": ["zero_particle_force"]}, {"dt": 0.0, "rcut": RCUT})
    return s.pairs.select("a", "b")


LATTICES = {"SC": 1, "2BCT": 4, "FCC": 4, "HCP": 4, "c-DIA": 8, "h-DIA": 8, "graphite": 8}


@query(sql="SELECT * FROM (VALUES ('SC', 512::BIGINT), ('2BCT', 2048), ('FCC', 2048), ('c-DIA', 4096)) t(structure, n)")
def lattice_structures(spark, folder):
    """How many atoms cubic structures put in a box of 8 x 8 x 8 cells."""
    box, rows = Domain.cube(16.0, 8), []
    for name in ("SC", "2BCT", "FCC", "c-DIA"):
        empty = State(emb(spark, folder).where("false"), box)
        made = run_pipeline(empty, [{"lattice": {"structure": name, "types": [0] * LATTICES[name], "size": (2.0, 2.0, 2.0), "shift": (0.01, 0.01, 0.01)}}]).particles
        rows.append(made.agg(F.lit(name).alias("structure"), F.count("*").alias("n")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
