"""Systems to run: crystals of nickel with pair forces, in angstrom, picosecond and dalton."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.domain import AXES, Domain
from cellframe.functions.vec import UNITS
from cellframe.operators.neighbors import pair_force
from cellframe.operators.transform import gaussian_noise
from cellframe.sources.particles import lattice
from cellframe.streaming.loop import Verlet

# Fixed values of the benchmark: lattice constant, well depth (eV), radius, mass, cut, skin, step.
NICKEL = {"a": 3.48, "epsilon": 0.3729, "sigma": 2.2808, "mass": 58.693, "rcut": 4.1, "skin": 2.0, "dt": 2e-3}
#: An electronvolt in dalton square angstrom a square picosecond.
EV = UNITS["eV"] / (UNITS["Da"] * (UNITS["ang"] / UNITS["ps"]) ** 2)


def nickel(spark: SparkSession, cells: int = 16, noise: float = 0.05) -> tuple[DataFrame, Domain, Verlet]:
    """A periodic cube of cells^3 unit cells of four atoms (16,384 for 16), displaced by noise, and its step."""
    k = NICKEL
    box = Domain.cube(k["a"] * cells, max(1, round(cells / 4)))
    atoms = gaussian_noise(lattice(spark, box, "FCC", [0] * 4, (k["a"],) * 3), "r", noise)
    r = F.sqrt("d2")
    s6 = F.pow(F.lit(k["sigma"]) / r, 6)
    slope = F.lit(-24.0 * k["epsilon"] * EV / k["mass"]) * (2.0 * s6 * s6 - s6) / r  # by mass: f is the acceleration
    return atoms, box, Verlet(k["dt"], k["rcut"], k["skin"], lambda df, pairs: pair_force(df, pairs, slope))


def kinetic(df: DataFrame) -> float:
    """Kinetic energy in electronvolt."""
    v2 = sum((F.col(f"v{a}") * F.col(f"v{a}") for a in AXES), F.lit(0.0))
    return df.agg(F.sum(v2)).first()[0] * NICKEL["mass"] / 2 / EV
