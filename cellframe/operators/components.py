"""Connected components of sub-cells above a threshold, and their table."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.domain import AXES, Domain
from cellframe.operators.cells import CELL, SUB, centre
from cellframe.operators.ranking import dense_number
from cellframe.operators.skew import heavy_keys, salted_join
from cellframe.runtime import Scratch


def z_order(domain: Domain, subdiv: int) -> str:
    """Expression text of a sub-cell's number: bits of the cell interleaved, widest axis first, then the sub-cell."""
    bits = max(1, max(d - 1 for d in domain.grid_dims).bit_length())
    axes = sorted(range(3), key=lambda a: (-domain.grid_dims[a], a))
    terms = [f"((shiftright({CELL[a]}, {b}) & 1) * {1 << (3 * b + (2 - k))}L)" for b in range(bits) for k, a in enumerate(axes)]
    sub = f"(sk * {subdiv} + sj) * {subdiv} + si"
    return f"({' + '.join(terms)}) * {subdiv**3}L + {sub}"


def least_labels(vertices: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(u, label): the smallest vertex each one reaches. vertices(u), edges(u, v) in both directions.

    A round takes the smallest label around every vertex and then the label of
    that label, so long chains close in a logarithmic number of rounds; a table is
    written after each. Labels that many vertices have are spread over tasks.
    """
    scratch = Scratch(vertices.sparkSession, "labels")
    edges = scratch.save(edges, "edges")
    labels = vertices.select("u", F.col("u").alias("label"))
    if edges.isEmpty():
        return labels
    labels = scratch.save(labels, "labels0")
    total = labels.count()
    for turn in range(1, max_rounds + 1):
        around = edges.join(labels.select(F.col("u").alias("v"), F.col("label").alias("l")), "v").groupBy("u").agg(F.min("l").alias("l"))
        low = labels.join(around, "u", "left").select("u", F.col("label").alias("old"), F.least(F.col("label"), F.coalesce("l", "label")).alias("label"))
        low = scratch.save(low, f"low{turn}")
        up = low.select(F.col("u").alias("label"), F.col("label").alias("top"))
        hot = heavy_keys(low.groupBy("label").count(), "label", "count", total)
        jumped = salted_join(low, up, "label", hot).select("u", "old", F.least("label", "top").alias("label"))
        jumped = scratch.save(jumped, f"jumped{turn}")
        labels = jumped.select("u", "label")
        if jumped.where("label <> old").isEmpty():
            return labels
        if turn > 1:
            scratch.drop(f"low{turn - 1}")
            scratch.drop(f"jumped{turn - 1}")
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


#: Sub-cells along an axis of a block, whose components are found in one task: 32,768 sub-cells at most.
BLOCK = 32


def _in_block(frame: pd.DataFrame) -> pd.DataFrame:
    """Adds `local`, the smallest u of a sub-cell's component within its block: the least of 27 around, until nothing changes."""
    at = tuple(frame[k].to_numpy() % BLOCK + 1 for k in ("kx", "ky", "kz"))
    off = np.iinfo(np.int64).max
    grid = np.full((BLOCK + 2,) * 3, off)
    grid[at] = frame["u"].to_numpy()
    on = grid < off
    while True:
        low = grid
        for axis in range(3):
            low = np.minimum(low, np.minimum(np.roll(low, 1, axis), np.roll(low, -1, axis)))
        low = np.where(on, low, off)
        if (low == grid).all():
            return frame.assign(local=grid[at])[["u", "kx", "ky", "kz", "local"]]
        grid = low


def label_components(cells: DataFrame, domain: Domain, subdiv: int, field: str, threshold: float, count_threshold: int = 1) -> DataFrame:
    """V with cc_label: dense labels of components of at least count_threshold sub-cells, -1 elsewhere.

    Sub-cells with a value of threshold or more are joined to their 26
    neighbours, across periodic faces too. Labels are ordered by the component's
    smallest number in z-order. Null values are below any threshold; sub-cells
    without a row belong to no component.

    Blocks of sub-cells are labelled each in one task; then only the components
    of blocks, linked by sub-cells at the blocks' faces, go through rounds.
    """
    scratch = Scratch(cells.sparkSession, "components")
    n = [d * subdiv for d in domain.grid_dims]
    place = [(F.col(c) * subdiv + F.col(s)).cast("int").alias(f"k{a}") for a, c, s in zip(AXES, CELL, SUB)]
    on = cells.where(F.col(field) >= threshold).select(F.expr(z_order(domain, subdiv)).alias("u"), *place)
    blocks = [F.floor(F.col(f"k{a}") / BLOCK).alias(f"b{a}") for a in AXES]
    local = scratch.save(on.groupBy(*blocks).applyInPandas(_in_block, "u long, kx int, ky int, kz int, local long"), "local")
    # Sub-cells at a face of their block, and the steps from there that leave the block or the box.
    inner = [F.pmod(F.col(f"k{a}"), F.lit(BLOCK)) for a in AXES]
    face = F.lit(False)
    for i, k in enumerate(inner):
        face = face | (k == 0) | (k == BLOCK - 1) | (F.col(f"k{AXES[i]}") == n[i] - 1)
    edge = local.where(face)
    around = F.expr(f"array({', '.join('named_struct(' + ', '.join(f'{chr(39)}o{a}{chr(39)}, {v}' for v, a in zip(o, AXES)) + ')' for o in itertools.product((-1, 0, 1), repeat=3) if o > (0, 0, 0))})")
    moved = edge.select(F.col("local").alias("v"), "kx", "ky", "kz", F.inline(around))
    left = F.lit(False)
    for a in AXES:
        left = left | (F.floor((F.col(f"k{a}") + F.col(f"o{a}")) / BLOCK) != F.floor(F.col(f"k{a}") / BLOCK)) | (F.col(f"k{a}") + F.col(f"o{a}") == n[AXES.index(a)])
    at = [F.pmod(F.col(f"k{a}") + F.col(f"o{a}"), F.lit(n[i])) if domain.periodic[i] else F.col(f"k{a}") + F.col(f"o{a}") for i, a in enumerate(AXES)]
    spread = moved.where(left).select("v", *(k.cast("int").alias(f"k{a}") for k, a in zip(at, AXES)))
    met = edge.select(F.col("local").alias("u"), "kx", "ky", "kz").join(spread, [f"k{a}" for a in AXES]).where("u <> v").select("u", "v").distinct()
    edges = met.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    parts = scratch.save(local.groupBy(F.col("local").alias("u")).agg(F.count("*").alias("size")), "parts")
    labels = scratch.save(least_labels(parts.select("u"), edges).join(parts, "u"), "labels")
    sizes = scratch.save(labels.groupBy("label").agg(F.sum("size").alias("cells"), F.count("*").alias("parts")), "sizes")
    dense = dense_number(sizes.where(F.col("cells") >= count_threshold).select("label"), ["label"], "cc_label")
    hot = heavy_keys(sizes, "label", "parts", parts.count())
    named = salted_join(labels.select("label", F.col("u").alias("local")), dense, "label", hot).select("local", "cc_label")
    found = local.join(named, "local").select(F.col("u").alias("__u"), "cc_label")
    return cells.drop("cc_label").withColumn("__u", F.expr(z_order(domain, subdiv))).join(found, "__u", "left").drop("__u").withColumn("cc_label", F.coalesce(F.col("cc_label"), F.lit(-1).cast("long")))


def component_table(labelled: DataFrame, domain: Domain, subdiv: int, sums: list[str] = (), averages: list[str] = ()) -> DataFrame:
    """label, count, centre, gyration tensor, and sums or averages of fields of every component.

    The centre is the mean of sub-cell centres in lab space; the tensor is the
    mean of (r - c)(r - c)^T, from sums of one pass over positions from the box's
    centre. On a periodic axis the coordinates are not unwrapped.
    """
    mid = domain.matrix @ [(lo + hi) / 2 for lo, hi in zip(domain.bmin, domain.bmax)]
    r = [c - float(m) for c, m in zip(centre(domain, subdiv), mid)]
    on = labelled.where(F.col("cc_label") >= 0).select(F.col("cc_label").alias("label"), *(c.alias(f"r{a}") for c, a in zip(r, AXES)), *sums, *averages)
    pairs = [(p, q) for i, p in enumerate(AXES) for q in AXES[i:]]
    means = [*(F.avg(f"r{a}").alias(f"r{a}") for a in AXES), *(F.avg(F.col(f"r{p}") * F.col(f"r{q}")).alias(f"m{p}{q}") for p, q in pairs)]
    out = on.groupBy("label").agg(F.count("*").alias("count"), *means, *(F.sum(s).alias(s) for s in sums), *(F.avg(s).alias(s) for s in averages))
    spread = {(p, q): F.col(f"m{p}{q}") - F.col(f"r{p}") * F.col(f"r{q}") for p, q in pairs}
    tensor = [spread[min(p, q), max(p, q)].alias(f"gyr_{p}{q}") for p in AXES for q in AXES]
    return out.select("label", "count", *((F.col(f"r{a}") + float(m)).alias(f"center_{a}") for a, m in zip(AXES, mid)), *tensor, *sums, *averages)
