"""An ordered list of named operators as one plan: dict in, DataFrame out."""

from __future__ import annotations

import inspect
import time as clock
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.domain import AXES, Domain, extend_domain, init_domain
from cellframe.operators import analytics, cells, checks, components, deform, neighbors, ranking, selection, snap, transform
from cellframe.operators.regions import Regions
from cellframe.sources import files, particles


@dataclass(frozen=True)
class State:
    """What operators read and write. Relations are lazy: what nobody reads is never computed."""

    particles: DataFrame
    domain: Domain
    regions: Regions = field(default_factory=Regions)
    types: DataFrame | None = None
    cell_values: DataFrame | None = None
    pairs: DataFrame | None = None
    plots: DataFrame | None = None
    mesh: DataFrame | None = None
    ghosts: DataFrame | None = None
    timestep: int = 0
    time: float = 0.0
    bag: dict = field(default_factory=dict)


OPERATORS: dict[str, Callable[..., State]] = {}


def operator(name: str):
    def register(f):
        OPERATORS[name] = f
        return f

    return register


def _on_particles(name: str, f: Callable[..., DataFrame], region: bool = False, domain: bool = False):
    def apply(s: State, **kw) -> State:
        if region:
            kw["regions"] = s.regions
        args = (s.particles, s.domain) if domain else (s.particles,)
        return replace(s, particles=f(*args, **kw))

    apply.takes = f
    OPERATORS[name] = apply


for _p in "rv":
    _on_particles(f"shift_{_p}", lambda df, value, regions=None, region=None, p=_p: transform.shift(df, p, value, regions, region), region=True)
    _on_particles(f"scale_{_p}", lambda df, value, regions=None, region=None, p=_p: transform.scale(df, p, value, regions, region), region=True)
for _n, _p in (("set_velocity", "v"), ("set_force", "f")):
    _on_particles(_n, lambda df, value, regions=None, region=None, p=_p: transform.assign(df, p, value, regions, region), region=True)
for _n, _d, _s in (("push_v_r", "r", "v"), ("push_f_v", "v", "f"), ("push_f_r", "r", "f")):
    _on_particles(_n, lambda df, domain, dt, dt_scale=1.0, mode="IDENTITY", d=_d, s=_s: transform.push_first(df, d, s, dt, dt_scale, domain, mode), domain=True)
_on_particles("push_f_v_r", lambda df, domain, dt, dt_scale=1.0, mode="INV_XFORM": transform.push_second(df, dt, dt_scale, domain, mode), domain=True)
_on_particles("zero_particle_force", transform.zero_force)
_on_particles("apply_xform", lambda df, xform: transform.apply_xform(df, xform))
_on_particles("set_particle_type", selection.set_particle_type, region=True, domain=True)
_on_particles("remove_particles", selection.remove_particles, region=True, domain=True)
_on_particles("remove_close_particles", selection.remove_close, domain=True)
_on_particles("compact_particle_ids", ranking.compact_ids, domain=True)
_on_particles("grid_clear", selection.clear)
_on_particles("grid_passthru", lambda df: df)


@operator("domain_override")
def _override(s: State, **changes) -> State:
    return replace(s, domain=s.domain.override(**changes))


@operator("particle_regions")
def _regions(s: State, **declared) -> State:
    r = s.regions
    for name, spec in declared.items():
        r = r.declare(name, **spec)
    return replace(s, regions=r)


@operator("track_region_particles")
def _track(s: State, names: Sequence[str], expressions: Sequence[str]) -> State:
    p, r = ranking.track_regions(s.particles, s.domain, s.regions, list(names), list(expressions))
    return replace(s, particles=p, regions=r)


@operator("replicate_domain")
def _replicate(s: State, repeat: Sequence[int]) -> State:
    p, d = particles.replicate(s.particles, s.domain, repeat)
    return replace(s, particles=p, domain=d)


@operator("lattice")
def _lattice(s: State, **kw) -> State:
    made = particles.lattice(s.particles.sparkSession, s.domain, regions=s.regions, start_id=ranking.next_id(s.particles), **kw)
    return replace(s, particles=s.particles.unionByName(made, allowMissingColumns=True))


@operator("chunk_neighbors")
def _neighbors(s: State, rcut: float, **kw) -> State:
    return replace(s, pairs=neighbors.neighbors(s.particles, s.domain, rcut, **kw))


@operator("particle_cell_projection")
def _project(s: State, splat: float, subdiv: int, values: dict) -> State:
    new = cells.project(s.particles, s.domain, splat, subdiv, values)
    return replace(s, cell_values=new if s.cell_values is None else cells.add_cell_values(s.cell_values, new))


@operator("grid_particle_histogram")
def _histogram(s: State, fields: Sequence[str], samples: int = 1024) -> State:
    return replace(s, plots=analytics.histogram(s.particles, selection.fields(s.particles.columns, list(fields)), samples))


@operator("grid_particle_slicing")
def _slicing(s: State, fields: Sequence[str], **kw) -> State:
    return replace(s, plots=analytics.slicing(s.particles, s.domain, selection.fields(s.particles.columns, list(fields)), **kw))


@operator("simulation_stats")
def _stats(s: State) -> State:
    return replace(s, bag=s.bag | {"simulation_stats": analytics.simulation_stats(s.particles)})


@operator("write_dump")
def _dump(s: State, path: str, **kw) -> State:
    files.write_dump(s.particles, s.domain, path, s.timestep, s.time, **kw)
    return s


@operator("domain")
def _domain(s: State, **spec) -> State:
    return replace(s, domain=init_domain(**spec))


@operator("domain_update")
def _domain_update(s: State) -> State:
    return replace(s, domain=s.domain.updated().check())


@operator("domain_volume")
def _volume(s: State) -> State:
    return replace(s, bag=s.bag | {"volume": s.domain.volume()})


@operator("domain_set_xform")
def _set_xform(s: State, xform) -> State:
    return replace(s, domain=s.domain.override(xform=tuple(xform)))


@operator("domain_extract_xform")
def _extract_xform(s: State) -> State:
    return replace(s, bag=s.bag | {"xform": s.domain.xform, "inv_xform": s.domain.inverse})


@operator("deformation_xform")
def _deformation(s: State, angles, extension=(1.0, 1.0, 1.0), mode: str = "SET") -> State:
    return replace(s, domain=deform.deformed(s.domain, deform.from_angles(angles, extension), mode))


@operator("xform_constant_strain_rate")
def _strain(s: State, dt: float, **kw) -> State:
    return replace(s, domain=deform.strain_step(s.domain, dt=dt, timestep=s.timestep, **kw)[0])


@operator("xform_time_interpolate")
def _interpolate(s: State, times, matrices) -> State:
    return replace(s, domain=deform.deformed(s.domain, deform.interpolated(times, matrices, s.time)))


@operator("xform_time_interpolate_byparts")
def _by_parts(s: State, times, matrices, dt: float) -> State:
    return replace(s, domain=deform.by_parts_step(s.domain, times, matrices, dt, s.timestep))


@operator("extend_domain")
def _extend(s: State) -> State:
    ends = s.particles.agg(*(f(f"r{a}").alias(f"{n}{a}") for f, n in ((F.min, "lo"), (F.max, "hi")) for a in AXES)).first()
    if ends.lox is None:
        return s
    return replace(s, domain=extend_domain(s.domain, (ends.lox, ends.loy, ends.loz), (ends.hix, ends.hiy, ends.hiz))[0])


@operator("particle_types")
def _types(s: State, **types) -> State:
    return replace(s, types=particles.particle_types(s.particles.sparkSession, types))


@operator("particle_type_add_properties")
def _type_properties(s: State, **properties) -> State:
    return replace(s, types=particles.add_type_properties(s.types, properties))


@operator("grid_insert_particles")
def _insert(s: State, particles_: Sequence[dict], type_ids: dict | None = None) -> State:
    return replace(s, particles=particles.insert(s.particles, s.domain, particles_, type_ids))


@operator("divide_force_by_type_scalar")
def _divide(s: State, prop: str, region: str | None = None) -> State:
    return replace(s, particles=transform.divide_force_by_type(s.particles, s.types, prop, s.regions, region))


@operator("lennard_jones_force")
def _lj(s: State, **kw) -> State:
    return replace(s, particles=neighbors.lennard_jones(s.particles, s.domain, **kw))


_lj.takes = neighbors.lennard_jones


@operator("gravitational_force")
def _gravity(s: State, g: float, rcut: float) -> State:
    return replace(s, particles=neighbors.gravity(s.particles, s.domain, s.types, g, rcut))


@operator("snap_force_generic")
def _snap(s: State, parameters: str, coefficients: str) -> State:
    return replace(s, particles=snap.snap_force(s.particles, s.domain, snap.parse(parameters, coefficients)))


@operator("average_neighbors_scalar")
def _average(s: State, nbh_field: str, avg_field: str, rcut: float, weight_function=(1.0,)) -> State:
    pairs = neighbors.neighbors(s.particles, s.domain, rcut, keep=(nbh_field,))
    return replace(s, particles=neighbors.average_neighbors(s.particles, pairs, nbh_field, avg_field, rcut, weight_function))


@operator("set_cell_values")
def _set_cells(s: State, field_name: str, value, grid_subdiv: int = 1, region: str | None = None) -> State:
    base = cells.all_sub_cells(s.particles.sparkSession, s.domain, grid_subdiv) if s.cell_values is None else s.cell_values
    return replace(s, cell_values=cells.set_cell_values(base, s.domain, grid_subdiv, field_name, value, s.regions, region))


@operator("read_cell_values")
def _read_cells(s: State, path: str, field_name: str, grid_subdiv: int = 1, order: str = "F") -> State:
    return replace(s, cell_values=files.read_cell_values(s.particles.sparkSession, path, s.domain, grid_subdiv, field_name, order))


@operator("fluid_friction")
def _friction(s: State, fields: Sequence[str], grid_subdiv: int = 1) -> State:
    at = cells.lookup(s.particles, s.cell_values, s.domain, grid_subdiv, list(fields))
    c, *u = (F.col(f) for f in fields)
    return replace(s, particles=transform.fluid_friction(at, c, u).select(*s.particles.columns))


@operator("cc_label")
def _components(s: State, field: str, threshold: float, grid_subdiv: int = 1, count_threshold: int = 1, sums=(), averages=()) -> State:
    labelled = components.label_components(s.cell_values, s.domain, grid_subdiv, field, threshold, count_threshold)
    return replace(s, cell_values=labelled, bag=s.bag | {"cc_table": components.component_table(labelled, s.domain, grid_subdiv, list(sums), list(averages))})


@operator("write_cc_table")
def _write_components(s: State, path: str, **kw) -> State:
    files.write_component_table(s.bag["cc_table"], path, **kw)
    return s


@operator("write_xyz")
def _write_xyz(s: State, path: str, fields=(".*",)) -> State:
    files.write_xyz(s.particles, s.domain, path, s.types, tuple(fields), s.time)
    return s


@operator("write_paraview")
def _write_points(s: State, path: str, fields: Sequence[str]) -> State:
    files.write_points(s.particles, path, selection.fields(s.particles.columns, list(fields)))
    return s


@operator("write_grid_vtk")
def _write_grid(s: State, path: str, fields: Sequence[str], grid_subdiv: int = 1) -> State:
    files.write_grid(s.cell_values, s.domain, grid_subdiv, path, list(fields))
    return s


@operator("write_plot1d")
def _write_plots(s: State, path: str, **kw) -> State:
    files.write_plots(s.plots, path, **kw)
    return s


@operator("read_dump")
def _read(s: State, path: str, **kw) -> State:
    p, d, step, time = files.read_dump(s.particles.sparkSession, path, **kw)
    return replace(s, particles=p, domain=d, timestep=step, time=time)


@operator("backup_r")
def _backup(s: State) -> State:
    return replace(s, bag=s.bag | {"backup_r": transform.quantised_backup(s.particles, s.domain), "backup_domain": s.domain})


@operator("restore_r")
def _restore(s: State) -> State:
    old = s.bag["backup_domain"]
    return replace(s, particles=transform.restore(s.particles, transform.backed_up(s.bag["backup_r"], old), old.xform, s.domain.xform))


@operator("copy_grid")
def _copy(s: State) -> State:
    return replace(s, bag=s.bag | {"grid_copy": s.particles})


@operator("copy_back_grid")
def _copy_back(s: State) -> State:
    return replace(s, particles=s.bag["grid_copy"])


for _n, _f in (
    ("grid_stats", lambda s: analytics.grid_stats(s.particles, s.domain)),
    ("debug_total_force", lambda s: analytics.total_force(s.particles)),
    ("chunk_neighbors_stats", lambda s: neighbors.neighbor_stats(s.particles, s.pairs)),
    ("check_particles_inside_cells", lambda s: checks.outside_cells(s.particles, s.domain)),
):
    OPERATORS[_n] = lambda s, n=_n, f=_f: replace(s, bag=s.bag | {n: f(s)})

#: Batches that a run has unless it gives its own: the second-order scheme around a force.
SCHEME: dict[str, list | dict] = {
    "compute_force_prolog": ["zero_particle_force"],
    "compute_force": ["nop"],
    "compute_force_epilog": ["nop"],
    "compute_all_forces_energy": ["compute_force_prolog", "compute_force", "compute_force_epilog"],
    "verlet_first_half": [{"push_f_v_r": {"dt_scale": 1.0, "mode": "INV_XFORM"}}, {"push_f_v": {"dt_scale": 0.5}}],
    "check_and_update_particles": ["move_particles"],
    "verlet_second_half": [{"push_f_v": {"dt_scale": 0.5}}],
    "numerical_scheme": ["verlet_first_half", "check_and_update_particles", "compute_all_forces_energy", "verlet_second_half"],
}


def resolve(name: str) -> str | None:
    """The registered name of an operator; the memory log is known under any vendor's prefix."""
    if name in OPERATORS:
        return name
    return "memory_log" if name.endswith("_memory_log") else None


def _flat(steps, batches: dict, within: tuple = ()) -> list[tuple[str, dict]]:
    out = []
    for step in steps:
        name, arguments = (step, None) if isinstance(step, str) else next(iter(step.items()))
        batch = batches.get(name)
        if isinstance(batch, list):
            if name in within:
                raise ValueError(f"batch {name!r} calls itself")
            out += _flat(batch, batches, (*within, name))
        else:
            out.append((name, (batch or {}) | (arguments or {})))
    return out


def run_pipeline(state: State, steps: Sequence[dict | str], batches: dict | None = None, settings: dict | None = None) -> State:
    """Applies [{"operator": {arguments}}, ...] in order; an unknown operator raises before anything runs.

    `batches` names lists of steps, and dicts of arguments that an operator has
    wherever it isn't given others. `settings` (dt, rcut and the like) go to every
    operator that has a parameter of the name and isn't given it.
    """
    named = _flat(steps, SCHEME | (batches or {}))
    if unknown := [n for n, _ in named if resolve(n) is None]:
        raise KeyError(f"unknown operators {unknown}")
    for name, arguments in named:
        f, began = OPERATORS[resolve(name)], clock.time()
        if settings:
            known = inspect.signature(getattr(f, "takes", f)).parameters
            arguments = {k: v for k, v in settings.items() if k in known} | arguments
        state = f(state, **arguments)
        if state.bag.get("stage_seconds") is not None:
            state = replace(state, bag=state.bag | {"stage_seconds": [*state.bag["stage_seconds"], (name, clock.time() - began)]})
    return state


from cellframe.plans import stages  # noqa: E402, F401  registers the further stages
