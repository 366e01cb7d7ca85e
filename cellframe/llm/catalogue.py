"""Queries of the training-data operators, and the SQL that gives the same rows."""

from __future__ import annotations

import hashlib
import importlib

from pyspark.sql import functions as F

from cellframe.functions.keys import uniform_key_sql
from cellframe.llm.groups import group_ids
from cellframe.llm.percentiles import FRACTIONS, digest, digest_percentiles, merge, percentiles
from cellframe.llm.sample import lasting_store, stable_sample
from cellframe.plans.catalogue import table

QUERIES, ORACLES = {}, {}
V = ["vx", "vy", "vz"]
SHARE = 0.05
SKIN2 = 16.0


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _values(day: str, where: str) -> str:
    parts = [f"SELECT type, {day} AS day, '{v}' AS component, {v} + 0.0 AS value FROM grid_fields WHERE isfinite({v}) AND type IS NOT NULL {where}" for v in V]
    return " UNION ALL ".join(parts)


PICKED = ", ".join(f"min(CASE WHEN k = greatest(1, ceil({q} * n)) THEN value END) AS p{round(q * 100):02d}" for q in FRACTIONS)
PERCENTILES = f"""WITH v AS ({_values("recorded_at::DATE", "AND recorded_at IS NOT NULL")} UNION ALL {_values("NULL::DATE", "")}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY type, day, component ORDER BY value) AS k, count(*) OVER (PARTITION BY type, day, component) AS n FROM v)
SELECT type, day, component, max(n) AS n, {PICKED} FROM ranked GROUP BY type, day, component"""


def _days(spark, folder):
    g = table(spark, folder, "grid_fields")
    return g.select("type", F.to_date("recorded_at").alias("day"), *V)


@query(PERCENTILES)
def p3_percentiles(spark, folder):
    """Exact percentiles of v per type, and per type and day; day is null for the whole."""
    return percentiles(_days(spark, folder), "type", "day", V)


# A double's lattice cell: 12 bits of exponent (with the sign apart) and 8 of mantissa; negative values count down from -1.
ABS = "abs(value)"
EXPONENT = f"CASE WHEN pow(2::DOUBLE, floor(log2({ABS}))) > {ABS} THEN floor(log2({ABS})) - 1 WHEN pow(2::DOUBLE, floor(log2({ABS})) + 1) <= {ABS} THEN floor(log2({ABS})) + 1 ELSE floor(log2({ABS})) END"
LATTICE_SQL = f"""v AS ({_values("recorded_at::DATE", "")}), e AS (SELECT *, CASE WHEN value = 0 THEN -1023 ELSE {EXPONENT} END AS e FROM v),
c AS (SELECT *, CASE WHEN value = 0 THEN 0 ELSE ((e + 1023) * 256 + floor(({ABS} / pow(2::DOUBLE, e) - 1) * 256))::BIGINT END AS a FROM e),
cells AS (SELECT type, day, component, CASE WHEN value < 0 THEN -1 - a ELSE a END AS cell FROM c)"""
RANKS = ", ".join(f"({q})" for q in FRACTIONS)
# Least and greatest size of a cell's values, by the cell counted without its sign.
LEAST = "CASE WHEN a = 0 THEN 0 ELSE pow(2::DOUBLE, a // 256 - 1023) * (1 + (a % 256) / 256) END"
MOST = f"CASE WHEN a = 0 THEN {(2**44 - 1) * 2.0**-1074!r}::DOUBLE ELSE pow(2::DOUBLE, a // 256 - 1023) * (1 + (a % 256 + 1) / 256 - {2.0**-52!r}::DOUBLE) END"


@query(f"WITH {LATTICE_SQL} SELECT type, day, component, cell, count(*) AS n FROM cells GROUP BY ALL")
def p3_digests(spark, folder):
    """The summaries of each type and day that add up: counts on the fixed lattice."""
    named = F.element_at(F.lit(V), F.col("component") + 1)
    return digest(_days(spark, folder).where("type is not null"), ["type", "day"], V).withColumn("component", named)


@query(
    f"""WITH {LATTICE_SQL}, n AS (SELECT type, component, cell, count(*) AS n FROM cells GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY type, component ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY type, component) AS total FROM n),
t AS (SELECT *, greatest(1, ceil(total * f)) AS rank FROM r, (VALUES {RANKS}) q(f)),
h AS (SELECT type, component, f::DOUBLE AS fraction, total::BIGINT AS total, cell < 0 AS neg, CASE WHEN cell < 0 THEN -1 - cell ELSE cell END AS a FROM t WHERE rank > upto - n AND rank <= upto)
SELECT type, component, fraction, total, CASE WHEN neg THEN -({MOST}) ELSE {LEAST} END AS lo, CASE WHEN neg THEN -({LEAST}) ELSE {MOST} END AS hi FROM h"""
)
def p3_merged(spark, folder):
    """Bounds of each percentile of a type, from the digests of its days."""
    days = digest(_days(spark, folder).where("type is not null"), ["type", "day"], V)
    named = F.element_at(F.lit(V), F.col("component") + 1)
    return digest_percentiles(merge(days, ["type"]), ["type"]).withColumn("component", named)


KEYS = "(SELECT id, type, step, proc_id FROM grid_fields WHERE id IS NOT NULL)"


@query(f"SELECT * FROM ({uniform_key_sql(KEYS, 'id', 7)}) WHERE u < {SHARE}")
def p4_sample(spark, folder):
    """The rows of the sampled 5 % of ids, fed in two arrivals: before and from the middle of arrived_at.

    The numbers and the threshold stay in the shared folder: a later session over
    the same table finds them there.
    """
    g = table(spark, folder, "grid_fields").select("id", "type", "step", "proc_id", "arrived_at")
    ends = g.agg(F.min("arrived_at").alias("lo"), F.max("arrived_at").alias("hi")).first()
    middle = F.lit(None).cast("timestamp_ntz") if ends.lo is None else F.lit(ends.lo + (ends.hi - ends.lo) / 2)
    early = F.coalesce(F.col("arrived_at") < middle, F.lit(False))
    store = lasting_store(spark, f"grid_fields-{hashlib.sha256(folder.encode()).hexdigest()[:16]}", seed=7)
    return stable_sample(g, SHARE, [early, ~early], store).drop("arrived_at")


LINKED = f"""WITH RECURSIVE links AS (
  SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM neighbors WHERE a <> b AND d2 <= {SKIN2} AND NOT isnan(d2)),
both_ways AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links),
reach(id, seed) AS (SELECT u, u FROM both_ways UNION SELECT v, seed FROM reach JOIN both_ways ON id = u WHERE seed < v)
SELECT id, min(seed) AS group_id FROM reach GROUP BY id"""


@query(LINKED)
def p5_found(spark, folder):
    """Each id of a counting pair with the smallest id of its group."""
    d2 = F.col("d2")
    return group_ids(table(spark, folder, "neighbors").where(d2.isNotNull() & ~F.isnan(d2) & (d2 <= SKIN2)))


for _name in ("token_queries", "leak_queries", "quality_queries"):
    try:
        importlib.import_module(f"cellframe.llm.{_name}").register(query)
    except ModuleNotFoundError as e:
        if e.name != f"cellframe.llm.{_name}":
            raise
