"""Validation of relations: each gives rows that tell, or raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.domain import AXES, Domain
from cellframe.functions.keys import uniform_key
from cellframe.functions.vec import norm2
from cellframe.runtime import text


def check_values(df: DataFrame, golden: DataFrame, domain: Domain, pos: float = 1e-16, vel: float = 1e-16, acc: float = 1e-16, fatal: bool = True) -> DataFrame:
    """One row of the L2 errors of r (nearest image), v and f against golden rows by id, and how many ids are missing.

    With `fatal` an error above its threshold, or a missing id, raises. Ids in
    golden twice, and rows of df that repeat an id, are compared each.
    """
    g = golden.select("id", *(F.col(f"{p}{a}").alias(f"__{p}{a}") for p in "rvf" for a in AXES))
    j = g.join(df, "id", "left")
    diff = {}
    for i, a in enumerate(AXES):
        d = F.col(f"r{a}") - F.col(f"__r{a}")
        diff[f"r{a}"] = d - F.round(d / domain.size[i]) * domain.size[i] if domain.periodic[i] else d
        diff |= {f"{p}{a}": F.col(f"{p}{a}") - F.col(f"__{p}{a}") for p in "vf"}
    error = lambda p: F.sqrt(F.coalesce(F.sum(norm2([diff[f"{p}{a}"] for a in AXES])), F.lit(0.0)))
    out = j.agg(error("r").alias("pos_error"), error("v").alias("vel_error"), error("f").alias("acc_error"), F.count(F.when(F.col("rx").isNull(), 1)).alias("missing"))
    if fatal:
        row = out.first()
        if row.missing or row.pos_error > pos or row.vel_error > vel or row.acc_error > acc:
            raise AssertionError(f"values differ from the golden rows: {row}")
    return out


def outside_cells(df: DataFrame, domain: Domain) -> DataFrame:
    """Rows whose position isn't in the cell that ci, cj, ck name."""
    ok = F.lit(True)
    for i, (a, c) in enumerate(zip(AXES, ("ci", "cj", "ck"))):
        lo = domain.bmin[i] + F.col(c) * domain.cell_size
        ok = ok & (F.col(f"r{a}") >= lo) & (F.col(f"r{a}") < lo + domain.cell_size)
    return df.where(~F.coalesce(ok, F.lit(False)))


def verify_pairs(fast: DataFrame, exact: DataFrame) -> DataFrame:
    """Pairs (a, b) that only one of two lists has, with the list's name; self pairs and one-way pairs of the first too."""
    ab = lambda d: d.select("a", "b")
    out = ab(fast).exceptAll(ab(exact)).withColumn("why", F.lit("only in first"))
    out = out.unionByName(ab(exact).exceptAll(ab(fast)).withColumn("why", F.lit("only in second")))
    back = ab(fast).select(F.col("b").alias("a"), F.col("a").alias("b"))
    return out.unionByName(ab(fast).exceptAll(back).withColumn("why", F.lit("one way")))


def array_sizes(df: DataFrame, sizes: dict[str, str | Column]) -> DataFrame:
    """Rows whose array columns don't have the length that another column, or an expression, gives; a null array has none."""
    bad = F.lit(False)
    for array, count in sizes.items():
        bad = bad | (F.size(array) != (F.col(count) if isinstance(count, str) else count))
    return df.where(bad)


def particles_by_id(df: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """The rows of the ids in order of id; all if none are given."""
    return (df.where(F.col("id").isin(ids)) if ids else df).orderBy("id")


def payload(df: DataFrame, fields, kind: str | None) -> None:
    """Raises if a field isn't there or isn't an array of doubles or of integers, as `kind` says; no kind allows any field."""
    want = {None: None, "double": ("array<double>",), "int": ("array<int>", "array<bigint>")}[kind]
    kinds = dict(df.dtypes)
    for f in fields:
        if f not in kinds or want and kinds[f] not in want:
            raise TypeError(f"field {f!r} is {kinds.get(f, 'missing')}, not an array of {kind}")


def draw(n: Column, seed: int) -> Column:
    return uniform_key(n, seed)


GOLDEN = ["id", *(f"{p}{a}" for p in "rfv" for a in AXES)]


def write_golden(df: DataFrame, file: str, samples: int = 128) -> None:
    """Golden rows of `samples` ids (those of the smallest keys) as text: a row a line, numbers in hexadecimal so that no bit is lost."""
    rows = df.where(F.col("id").isNotNull()).select(*GOLDEN).orderBy(uniform_key(F.col("id"), 0), "id").limit(samples).collect()
    lines = [f"- [{r[0]}, {', '.join('null' if v is None else float(v).hex() for v in r[1:])}]" for r in sorted(rows)]
    text(df.sparkSession, file, "\n".join(["length_unit: 1.0", "values:", *lines]) + "\n")


def read_golden(spark: SparkSession, file: str) -> DataFrame:
    """id, r, f, v of a file of golden rows; its length is that of the sample."""
    rows = []
    for line in spark.read.text(file).where(F.col("value").startswith("- [")).collect():
        n, *values = (x.strip() for x in line.value[3:].rstrip(" ]").split(","))
        rows.append((int(n), *(None if v == "null" else float.fromhex(v) for v in values)))
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in GOLDEN[1:]))
