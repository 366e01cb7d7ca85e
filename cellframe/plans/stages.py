"""Further stages of the pipeline: blocks and owners, images, neighbour lists, meshes, checks, prints and control values.

What a stage finds that isn't a relation of the state goes into its bag under the stage's name.
"""

from __future__ import annotations

import json
import re
import time as clock
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import functions as F

from cellframe.domain import AXES
from cellframe.functions.keys import uniform_key_int
from cellframe.functions.vec import matvec, vec
from cellframe.operators import analytics, cells, checks, mesh, neighbors, partitioning, ranking, selection, transform, vertices
from cellframe.operators.regions import located
from cellframe.plans import control
from cellframe.plans.pipeline import State, operator
from cellframe.runtime import Scratch, exists
from cellframe.sources import files


def keep(s: State, **found) -> State:
    return replace(s, bag=s.bag | found)


def show(s: State, name: str, text: str) -> State:
    """Prints a text, and keeps it."""
    print(text)
    return keep(s, **{name: text})


# blocks, owners, moves


@operator("init_rcb_grid")
@operator("load_balance_no_costs")
def _even(s: State, parts: int = 8) -> State:
    return keep(s, blocks=partitioning.even_blocks(s.domain, parts), imbalance=0.1)


@operator("load_balance_random")
def _random_blocks(s: State, parts: int = 8, seed: int = 0) -> State:
    blocks = partitioning.even_blocks(s.domain, parts, lambda n: uniform_key_int(n, seed))
    return keep(s, blocks=blocks, imbalance=0.1)


@operator("load_balance_rcb")
def _rcb(s: State, parts: int = 8) -> State:
    costs = s.bag.get("simple_cost_model")
    blocks = partitioning.recursive_bisection(analytics.cell_costs(s.particles, s.domain) if costs is None else costs, s.domain, parts)
    each = [c for *_, c in blocks]
    mean = sum(each) / len(each)
    return keep(s, blocks=blocks, imbalance=(max(each) - mean) / mean if mean else 0.0)


@operator("cpu_gpu_load_balance")
def _cpu_gpu(s: State, cpu_gpu_perf_ratio: float = 8.0, gpu_cell_particles_threshold: int = 16) -> State:
    return keep(s, cpu_gpu_partition=partitioning.two_speeds(analytics.cell_counts(s.particles, s.domain), cpu_gpu_perf_ratio, gpu_cell_particles_threshold))


def _blocks(s: State):
    if "blocks" not in s.bag:
        raise ValueError("no blocks: init_rcb_grid or a load_balance stage comes first")
    return s.bag["blocks"]


@operator("cell_owner_rank")
def _owners(s: State) -> State:
    grid = cells.all_sub_cells(s.particles.sparkSession, s.domain).select(*cells.CELL)
    return keep(s, cell_owner=grid.withColumn("owner", partitioning.owner(_blocks(s))))


@operator("subdomain_neighbors")
def _near_blocks(s: State, ghost_layers: int = 1) -> State:
    return keep(s, subdomain_neighbors=partitioning.neighbour_blocks([b[:2] for b in _blocks(s)], ghost_layers, s.domain))


def _migrate(payload: str | None):
    def stage(s: State, fields: Sequence[str] = ()) -> State:
        checks.payload(s.particles, fields, payload)
        moved = partitioning.partition_by_owner(s.particles, s.domain, _blocks(s))
        values = s.cell_values if s.cell_values is None else cells.add_cell_values(s.cell_values)
        return replace(s, particles=moved, cell_values=values)

    return stage


def _move(payload: str | None):
    def stage(s: State, fields: Sequence[str] = ()) -> State:
        checks.payload(s.particles, fields, payload)
        inside, outside = transform.move_particles(s.particles, s.domain)
        return keep(replace(s, particles=inside), otb_particles=outside)

    return stage


for _n, _kind in (("", None), ("_double", "double"), ("_int", "int")):
    operator(f"migrate_cell_particles{_n}")(_migrate(_kind))
    operator(f"move_particles{_n}")(_move(_kind))


@operator("backup_r_lt_move_data")
def _move_backup(s: State) -> State:
    """The long-term backup's rows of the particles that are there."""
    old = s.bag["backup_r"]
    return keep(s, backup_r_lt=old.join(s.particles.select("id").distinct(), "id", "left_semi"))


# images


def _reach(s: State, distance: float | None) -> float:
    if distance is None and "nbh_dist" not in s.bag:
        raise ValueError("no ghost distance: give one, or let nbh_dist come first")
    return s.bag["nbh_dist"]["ghost_dist"] if distance is None else distance


@operator("ghost_comm_scheme")
def _scheme(s: State, distance: float | None = None) -> State:
    ghosts = partitioning.periodic_images(s.particles, s.domain, _reach(s, distance)).where("is_ghost")
    return keep(s, ghost_comm_scheme=ghosts.select("id", "ix", "iy", "iz"), ghost_dist=_reach(s, distance))


def _ghosts(which: str, values: bool):
    def stage(s: State, distance: float | None = None, opt_fields: Sequence[str] = (), grid_subdiv: int = 1) -> State:
        reach = s.bag["ghost_dist"] if distance is None and "ghost_dist" in s.bag else _reach(s, distance)
        names = [c for c in s.particles.columns if c != "id" and c not in ("rx", "ry", "rz")]
        carried = {"all": names, "all_no_fv": [c for c in names if not re.fullmatch("[fv][xyz]", c)], "r": [], "opt": selection.fields(names, list(opt_fields))}[which]
        images = partitioning.periodic_images(s.particles.select("id", "rx", "ry", "rz", *carried), s.domain, reach).where("is_ghost")
        s = replace(s, ghosts=images)
        if values and s.cell_values is not None:
            s = keep(s, ghost_cell_values=cells.cell_images(s.cell_values, s.domain, max(1, -(-reach // s.domain.cell_size))), ghost_subdiv=grid_subdiv)
        return s

    return stage


for _n in ("all", "all_no_fv", "r", "opt"):
    operator(f"ghost_update_{_n}")(_ghosts(_n, True))
    operator(f"ghost_update_{_n}_no_gcv")(_ghosts(_n, False))


def _from_ghosts(which: str):
    def stage(s: State, opt_fields: Sequence[str] = ()) -> State:
        if which != "gcv":
            names = [f"f{a}" for a in AXES] if which == "force" else selection.fields(s.ghosts.columns, list(opt_fields))
            s = replace(s, particles=partitioning.add_from_images(s.particles, s.ghosts, names))
        return s

    return stage


def _values_from_ghosts(s: State, **_) -> State:
    """The values of cells beyond the periodic faces, added to the cells that they are images of."""
    images = s.bag.get("ghost_cell_values")
    return s if images is None else replace(s, cell_values=cells.add_cell_values(s.cell_values, cells.wrap_cells(images, s.domain)))


def _both(first, second):
    return lambda s, **kw: second(first(s, **kw))


operator("update_gcv_from_ghost")(_values_from_ghosts)
for _n in ("force", "opt"):
    operator(f"update_{_n}_from_ghost")(_both(_from_ghosts(_n), _values_from_ghosts))
    operator(f"update_{_n}_from_ghost_no_gcv")(_from_ghosts(_n))


@operator("update_ghost_config")
def _ghost_config(s: State, **options) -> State:
    return keep(s, update_ghost_config=s.bag.get("update_ghost_config", {}) | options)


@operator("grid_clear_ghosts")
def _no_ghosts(s: State) -> State:
    return replace(s, ghosts=None, bag={k: v for k, v in s.bag.items() if k != "ghost_cell_values"})


def _by_shift(s: State) -> list:
    return s.bag["ghost_comm_scheme"].groupBy("ix", "iy", "iz").count().orderBy("ix", "iy", "iz").collect()  # 26 rows at most


@operator("print_ghost_comm_scheme")
def _print_scheme(s: State) -> State:
    return show(s, "print_ghost_comm_scheme", "\n".join(f"shift {r.ix:2d} {r.iy:2d} {r.iz:2d}: {r['count']} particles" for r in _by_shift(s)))


@operator("print_ghost_comm_stats")
def _print_scheme_stats(s: State) -> State:
    counts = [r["count"] for r in _by_shift(s)] or [0]
    return show(s, "print_ghost_comm_stats", f"particles by shift: min {min(counts)} max {max(counts)} avg {sum(counts) / len(counts):.3f}")


@operator("debug_print_ghosts")
def _print_ghosts(s: State) -> State:
    """Ghosts first, then particles, in order of id."""
    ghosts = partitioning.periodic_images(s.particles, s.domain, s.bag["ghost_dist"]).where("is_ghost") if s.ghosts is None else s.ghosts
    both = ghosts.unionByName(s.particles.withColumn("is_ghost", F.lit(False)), allowMissingColumns=True)
    return keep(s, debug_print_ghosts=both.orderBy(~F.col("is_ghost"), "id"))


# noise, restricted to a region, a mask value or both


def _noise(kind: str, prefix: str):
    def stage(s: State, sigma: float = 1.0, sigma_cut: float | None = None, region: str | None = None, grid_cell_mask_name: str | None = None, grid_cell_mask_value: float | None = None, grid_subdiv: int = 1, seed: int | None = None) -> State:
        """Positions are tested in lab space; draws differ by field and step unless a seed is given."""
        df, where = s.particles, None
        if grid_cell_mask_name is not None:
            df = cells.lookup(df, s.cell_values.select(*cells.KEY, F.col(grid_cell_mask_name).alias("__mask")), s.domain, grid_subdiv, ["__mask"])
        if region is not None or grid_cell_mask_name is not None:
            where = located(s.regions, region, matvec(s.domain.xform, vec("r")), F.col("id"), F.col("__mask") if grid_cell_mask_name else None, grid_cell_mask_value)
        seed = 3 * s.timestep + "rvf".index(prefix) if seed is None else seed
        out = transform.gaussian_noise(df, prefix, sigma, sigma_cut, seed, where) if kind == "gaussian" else transform.uniform_noise(df, prefix, sigma, seed, where)
        return replace(s, particles=out.drop("__mask"))

    return stage


for _p in "rvf":
    for _kind in ("gaussian", "uniform"):
        operator(f"{_kind}_noise_{_p}")(_noise(_kind, _p))


# neighbours


@operator("nbh_dist")
def _distances(s: State, **kw) -> State:
    return keep(s, nbh_dist=neighbors.nbh_dist(s.domain, **kw))


@operator("chunk_neighbors_init")
def _no_pairs(s: State) -> State:
    return replace(s, pairs=neighbors.empty_pairs(s.particles.sparkSession))


@operator("rebuild_amr")
def _sub_grids(s: State, sub_grid_density: float = 5.0, enforced_ordering: int = 1) -> State:
    return keep(s, amr=partitioning.sub_grids(analytics.cell_counts(s.particles, s.domain), sub_grid_density, enforced_ordering))


@operator("amr_grid_pairs")
def _sub_pairs(s: State, distance: float | None = None, subdiv: int = 1) -> State:
    return keep(s, amr_grid_pairs=neighbors.cell_pair_offsets(s.domain, s.bag["nbh_dist"]["nbh_dist"] if distance is None else distance, subdiv))


@operator("compute_primary_neighbors")
def _primary(s: State, rcut: float) -> State:
    return keep(s, primary_neighbors=neighbors.primary(s.particles, s.domain, rcut))


@operator("compute_dual_neighbors")
def _dual(s: State) -> State:
    return keep(s, dual_neighbors=neighbors.dual(s.bag["primary_neighbors"]))


@operator("verify_chunk_neighbors")
def _verify(s: State) -> State:
    """The list against primary and dual lists of the same distance together."""
    exact = s.bag["primary_neighbors"].select("a", "b").unionByName(s.bag["dual_neighbors"].select("a", "b"))
    return keep(s, verify_chunk_neighbors=checks.verify_pairs(s.pairs, exact))


@operator("debug_particle_distance")
def _image_distances(s: State, id1: int, id2: int, dist_max: float = -1.0) -> State:
    return keep(s, debug_particle_distance=neighbors.image_distances(s.particles, s.domain, id1, id2, dist_max))


# meshes


@operator("trimesh_init")
def _mesh(s: State, mesh_: dict | None = None, path: str | None = None) -> State:
    spark = s.particles.sparkSession
    return replace(s, mesh=mesh.read_triangles(spark, path) if path else mesh.triangles(spark, mesh_["vertices"], mesh_["triangles"]))


@operator("grid_triangle_intersections")
def _cell_triangles(s: State, distance: float = 0.0) -> State:
    return keep(s, grid_to_triangles=mesh.bucket(s.mesh, s.domain.cell_size, distance, s.domain.bmin))


@operator("trimesh_proximity")
def _proximity(s: State, max_dist: float) -> State:
    return keep(s, trimesh_proximity=mesh.proximity(s.particles, s.mesh, max_dist))


@operator("trimesh_collision")
def _collision(s: State, dt: float) -> State:
    return keep(s, trimesh_collision=mesh.collision(s.particles, s.mesh, dt, s.domain.cell_size))


@operator("chunk_neighbors_no_surface_crossing")
def _uncrossed(s: State, rcut: float) -> State:
    pairs = neighbors.neighbors(s.particles, s.domain, rcut)
    return replace(s, pairs=mesh.without_crossings(s.particles, pairs, s.mesh, s.domain.cell_size))


# cells, costs


@operator("resize_grid_cell_values")
def _resize(s: State, grid_subdiv: int = 1) -> State:
    """The sub-cells of the grid: all of them if there are no values, otherwise those with values inside it."""
    if s.cell_values is None:
        return replace(s, cell_values=cells.all_sub_cells(s.particles.sparkSession, s.domain, grid_subdiv))
    inside = F.lit(True)
    for c, n in zip(cells.CELL, s.domain.grid_dims):
        inside = inside & (F.col(c) >= 0) & (F.col(c) < n)
    return replace(s, cell_values=s.cell_values.where(inside))


@operator("simple_cost_model")
def _costs(s: State, coefficients=(0.0, 0.0, 1.0, 0.0), type_weights: dict | None = None) -> State:
    return keep(s, simple_cost_model=analytics.cell_costs(s.particles, s.domain, coefficients, type_weights))


@operator("cost_model_fit")
def _fit(s: State, measured, samples: int = 256, order: int = 3) -> State:
    return keep(s, cost_model_coefs=analytics.fit_cost_model(measured, samples, order))


@operator("performance_adviser")
def _advice(s: State, threads: int = 1, ghost_dist: float = 0.0) -> State:
    n, total = s.particles.count(), s.domain.grid_dims[0] * s.domain.grid_dims[1] * s.domain.grid_dims[2]
    return keep(s, performance_adviser=analytics.performance_advice(n, total, threads, s.domain.cell_size, ghost_dist))


@operator("start_grid_cell_profiling")
def _profile(s: State) -> State:
    """From here on the seconds of each stage are kept."""
    return keep(s, stage_seconds=[], profiling_since=clock.time())


@operator("grid_memory_compact")
def _compact(s: State) -> State:
    """The particles written anew to the shared folder: their lineage ends there."""
    return replace(s, particles=Scratch(s.particles.sparkSession, "compact").save(s.particles, "particles"))


# backups


@operator("check_backup_r")
def _check_backup(s: State) -> State:
    """Raises if the backup has cells that the grid lacks."""
    old = s.bag["backup_r"]
    outside = F.lit(False)
    for c, n in zip(cells.CELL, s.bag["backup_domain"].grid_dims):
        outside = outside | (F.col(c) < 0) | (F.col(c) >= n)
    if s.bag["backup_domain"].grid_dims != s.domain.grid_dims or not old.where(outside).isEmpty():
        raise AssertionError("the backup isn't of this grid")
    return s


@operator("backup_xform")
def _backup_xform(s: State) -> State:
    return keep(s, backup_xform=s.domain.xform)


@operator("particle_displ_over")
def _displaced(s: State, threshold: float, async_: bool = False) -> State:
    """Whether a particle moved by the threshold since backup_r; with async_ the answer is taken by particle_displ_over_async_end."""
    old = s.bag["backup_domain"]
    found = analytics.displaced(s.particles, transform.backed_up(s.bag["backup_r"], old), threshold, s.domain.xform, old.xform)
    return keep(s, particle_displ_over=found) if async_ else keep(s, particle_displ_over=found, result=found.first().result)


@operator("particle_displ_over_async_end")
def _displaced_end(s: State) -> State:
    return keep(s, result=s.bag["particle_displ_over"].first().result)


# checks and debugging


@operator("check_values")
def _check(s: State, file: str, samples: int = 128, threshold: float = 1e-16, pos_threshold: float | None = None, vel_threshold: float | None = None, acc_threshold: float | None = None, fatal: bool = True) -> State:
    """Compares with the golden rows of a file, which is written from a sample of the ids where there is none."""
    spark = s.particles.sparkSession
    if not exists(spark, file):
        checks.write_golden(s.particles, file, samples)
    golden = checks.read_golden(spark, file)
    limit = lambda x: threshold if x is None else x
    return keep(s, check_values=checks.check_values(s.particles, golden, s.domain, limit(pos_threshold), limit(vel_threshold), limit(acc_threshold), fatal))


for _n in ("double", "int"):

    @operator(f"check_es_consistency_{_n}")
    def _array_sizes(s: State, sizes: dict, kind: str = _n) -> State:
        checks.payload(s.particles, list(sizes), kind)
        if not checks.array_sizes(s.particles, sizes).isEmpty():
            raise AssertionError("an array doesn't have the length that its row names")
        return s


@operator("check_random_engine")
def _draws(s: State, cycles: int = 10, samples: int = 20, seed: int = 0) -> State:
    """Keyed draws of each cycle: the same in every run and layout."""
    draws = s.particles.sparkSession.range(cycles * samples).select(F.floor(F.col("id") / samples).cast("int").alias("cycle"), (F.col("id") % samples).cast("int").alias("sample"), checks.draw(F.col("id"), seed).alias("u"))
    return keep(s, check_random_engine=draws)


@operator("debug_particle")
def _debug(s: State, ids: Sequence[int] = (), filename: str | None = None) -> State:
    found = checks.particles_by_id(s.particles, list(ids))
    if filename:
        found.write.mode("overwrite").json(filename)
    return keep(s, debug_particle=found)


@operator("track_region_particles_multiple")
def _track_many(s: State, names: Sequence[str], expressions: Sequence[str]) -> State:
    p, r = ranking.track_regions(s.particles, s.domain, s.regions, list(names), list(expressions))
    return replace(s, particles=p, regions=r)


# prints


@operator("print_domain")
def _print_domain(s: State) -> State:
    return show(s, "print_domain", files.describe(s.domain))


@operator("print_grid")
def _print_grid(s: State, ghost_layers: int = 0) -> State:
    return show(s, "print_grid", files.describe_grid(s.domain, ghost_layers))


@operator("print_simulation_stats")
def _print_stats(s: State) -> State:
    return show(s, "print_simulation_stats", files.stats_line(s.timestep, s.time, analytics.simulation_stats(s.particles).first()))


@operator("print_plot1d")
def _print_plots(s: State, plot_names: Sequence[str] = (), nmarks: int = 10, scaling: float = 1.0) -> State:
    names = list(plot_names) or [r.plot for r in s.plots.select("plot").distinct().orderBy("plot").collect()]  # one row a plot
    return show(s, "print_plot1d", "\n".join(f"{n}\n{files.ascii_plot(s.plots.where(F.col('plot') == n), nmarks, scaling)}" for n in names))


@operator("print_histogram")
def _print_histogram(s: State, message: str = "histogram", nmarks: int = 10, scaling: float = 1.0) -> State:
    """Each histogram as bars, with the bin where the running sum of its values comes nearest to half."""
    median = {r.plot: r.bin for r in analytics.weighted_median_bin(s.plots).collect()}  # one row a plot
    bars = [files.ascii_plot(s.plots.where(F.col("plot") == n), nmarks, scaling).splitlines() for n in sorted(median)]
    text = [f"{n}\n" + "\n".join(line + (" <" if i == median[n] else "") for i, line in enumerate(b)) for n, b in zip(sorted(median), bars)]
    return show(s, "print_histogram", "\n".join([message, *text]))


# control values


@operator("before_timestep")
def _before(s: State, end_at: int) -> State:
    return keep(s, result=control.before_timestep(s.timestep, end_at))


@operator("timestep_file")
def _file_name(s: State, format: str) -> State:
    return keep(s, filename=control.timestep_file(format, s.timestep))


@operator("value_scale")
def _scale(s: State, in_value: float, scale: float = 1.0) -> State:
    return keep(s, out_value=control.value_scale(in_value, scale))


@operator("input_text")
def _ask_text(s: State, mesg: str = "input: ", given: dict | None = None) -> State:
    """A parameter named by the message; nothing is read from a terminal, as jobs run unattended."""
    return keep(s, text=control.ask(str, given or {}, mesg, ""))


@operator("input_integer")
def _ask_integer(s: State, mesg: str = "input: ", given: dict | None = None) -> State:
    return keep(s, value=control.ask(int, given or {}, mesg, 0))


@operator("lb_event_counter")
def _count_events(s: State, lb_flag: bool = False, move_flag: bool = False, domain_extended: bool = False) -> State:
    return keep(s, events=s.bag.get("events", control.Events()).seen(lb_flag, move_flag, domain_extended, s.bag.get("imbalance", 0.0)))


@operator("memory_log")
def _memory_log(s: State, enable: bool = True) -> State:
    """The session's own figures on storage memory, where enabled."""
    if not enable:
        return keep(s, memory_log=None)
    held = s.particles.sparkSession.sparkContext._jsc.sc().getExecutorMemoryStatus()
    return keep(s, memory_log=json.dumps({"executors": held.size()}))


# rendering


@operator("egl_particles_to_vertex_buffer")
def _vertex_buffer(s: State, vertex_attribs: dict[str, int], vertex_buffer: str = "particles") -> State:
    return keep(s, **{vertex_buffer: vertices.vertex_buffer(s.particles, vertex_attribs, s.ghosts)})


@operator("egl_particles_noghost_elements")
def _elements(s: State, vertex_buffer: str = "particles", elements: str = "noghost_particles") -> State:
    return keep(s, **{elements: vertices.elements(s.bag[vertex_buffer])})


# What a shared-memory, message-passing program needs and a plan doesn't have: locks, barriers, communicators.
@operator("resize_particle_locks")
@operator("mpi_barrier")
@operator("mpi_dup")
@operator("nop")
def _nothing(s: State, **_) -> State:
    return s
