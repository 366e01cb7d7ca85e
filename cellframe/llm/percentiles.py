"""Exact percentiles per group by bisection of value intervals.

Doubles map to 64-bit integers of the same order. For each group and percentile
an interval of keys is kept that holds the target rank. A pass counts the rows
below the dividing points of every interval and keeps the part with the rank;
after the passes the interval is one value. The first pass also gives the
digest: counts on a fixed lattice of keys, which adds up over days and files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.operators.skew import heavy_keys, salted_join
from cellframe.runtime import BROADCAST_ROWS, Scratch

FRACTIONS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
#: Bits of a lattice cell: sign, 11 of exponent and 8 of mantissa, so values of a cell differ by less than 2**-8 of themselves.
LATTICE = 20
STEP = 15
FLUSH = 1 << 18


def to_key(v: np.ndarray) -> np.ndarray:
    """Order-preserving int64 of finite doubles; both zeros are one key."""
    bits = (v + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def from_key(k: np.ndarray) -> np.ndarray:
    k = np.asarray(k, np.int64)
    return np.where(k < 0, k ^ np.int64(0x7FFFFFFFFFFFFFFF), k).view(np.float64)


def _value(k: Column) -> Column:
    return F.pandas_udf(lambda s: pd.Series(from_key(s.to_numpy(np.int64))), "double")(k)


def _counted(values: int):
    """(group..., v...) batches to counts of (group, component, lattice cell), added up within the split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        size = 0

        def flush():
            t = pa.concat_tables(kept)
            t = t.group_by(t.column_names[:-1], use_threads=False).aggregate([("n", "sum")]).rename_columns([*t.column_names[:-1], "n"])
            return t

        for batch in batches:
            for i in range(values):
                v = batch.column(batch.num_columns - values + i).to_numpy(zero_copy_only=False).astype(np.float64)
                good = np.isfinite(v)
                groups = pa.Table.from_batches([batch]).select(range(batch.num_columns - values)).filter(pa.array(good))
                cells = pa.array(to_key(v[good]) >> (64 - LATTICE), pa.int64())
                t = groups.append_column("component", pa.array(np.full(good.sum(), i, np.int32))).append_column("cell", cells).append_column("n", pa.array(np.ones(good.sum(), np.int64)))
                kept.append(t.group_by(t.column_names[:-1], use_threads=False).aggregate([("n", "sum")]).rename_columns(t.column_names))
                size += kept[-1].num_rows
            if size > FLUSH:
                kept[:] = [flush()]
                size = kept[0].num_rows
                if size > FLUSH // 2:
                    yield from kept.pop().to_batches()
                    size = 0
        if kept:
            yield from flush().to_batches()

    return run


def _keyed(values: int):
    """(group..., v...) batches to rows (group..., component, key) of finite values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(values):
                v = batch.column(batch.num_columns - values + i).to_numpy(zero_copy_only=False).astype(np.float64)
                good = np.isfinite(v)
                t = pa.Table.from_batches([batch]).select(range(batch.num_columns - values)).filter(pa.array(good))
                yield from t.append_column("component", pa.array(np.full(good.sum(), i, np.int32))).append_column("key", pa.array(to_key(v[good]), pa.int64())).to_batches()

    return run


def _ddl(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def digest(df: DataFrame, groups: list[str], values: list[str]) -> DataFrame:
    """Counts of finite values on the fixed lattice: groups..., component, cell, n.

    Digests of days or files over the same lattice are joined by merge(); each
    holds at most 2**20 cells a group, whatever the number of rows.
    """
    wanted = df.select(*groups, *(F.col(v).cast("double").alias(v) for v in values))
    counted = wanted.mapInArrow(_counted(len(values)), f"{_ddl(wanted, groups)}, component int, cell long, n long")
    return counted.groupBy(*groups, "component", "cell").agg(F.sum("n").alias("n"))


def merge(digests: DataFrame, groups: list[str]) -> DataFrame:
    """One digest for the coarser groups: the counts of a cell add up."""
    return digests.groupBy(*groups, "component", "cell").agg(F.sum("n").alias("n"))


def _targets(cells: DataFrame, groups: list[str]) -> DataFrame:
    """For each group, component and fraction the cell with the target rank, the rank within it, and the group's size."""
    keys = [*groups, "component"]
    before = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cells.withColumns({"before": F.coalesce(F.sum("n").over(before), F.lit(0)), "total": F.sum("n").over(Window.partitionBy(*keys))})
    rank = lambda q: F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(q))).cast("long")
    held = F.filter(F.array(*(F.struct(F.lit(q).alias("fraction"), rank(q).alias("rank")) for q in FRACTIONS)), lambda s: (s["rank"] > F.col("before")) & (s["rank"] <= F.col("before") + F.col("n")))
    return ranked.select(*keys, "cell", "before", "total", F.inline(held)).withColumn("rank", F.col("rank") - F.col("before")).drop("before")


def digest_percentiles(digests: DataFrame, groups: list[str]) -> DataFrame:
    """Bounds of each percentile from a digest: groups, component, fraction, total, lo, hi with lo <= exact <= hi.

    Both bounds lie in one lattice cell: hi - lo is below 2**-8 of the larger
    magnitude (below 2**-1022 around zero).
    """
    t = _targets(digests, groups)
    shift = 64 - LATTICE
    return t.select(*groups, "component", "fraction", "total", _value(F.shiftleft("cell", shift)).alias("lo"), _value(F.shiftleft("cell", shift) + F.lit((1 << shift) - 1)).alias("hi"))


def percentiles(df: DataFrame, group: str, part: str, values: list[str], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Exact percentiles of finite values, per group and part of it, and per group as a whole (part null).

    Columns: group, part, component (the value's name), n, p01 .. p99. The
    percentile of fraction q is the value of rank max(1, ceil(q * n)) in
    ascending order: an element of the data, error 0. Rows with a null group
    belong to no group; rows with a null part count for the whole only. Nulls,
    NaN and infinite values don't count; a group with no finite value of a
    component has no row for it. Ties and repeated rows count each. Up to
    broadcast_rows intervals go to every task; more meet the values by shuffle.
    """
    scratch = Scratch(df.sparkSession, "percentiles")
    rows = df.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(part).alias("p"), *values)
    parts = scratch.save(digest(rows, ["g", "p"], values), "digest")
    whole = merge(parts, ["g"]).withColumns({"p": F.lit(None).cast(df.schema[part].dataType), "whole": F.lit(True)})
    each = parts.where(F.col("p").isNotNull()).withColumn("whole", F.lit(False))
    names = ["g", "p", "whole"]
    state = scratch.save(_targets(each.unionByName(whole), names).withColumnRenamed("cell", "prefix"), "state0")
    goal = state.count()
    # The rows of the intervals still open: the lattice cells that hold a target.
    shift = 64 - LATTICE
    open_ = state.select(*names, "component", "prefix").distinct()
    keyed = rows.mapInArrow(_keyed(len(values)), f"{_ddl(rows, ['g', 'p'])}, component int, key long").withColumn("prefix", F.shiftright("key", shift))
    ends = open_.where("whole").select("g", "component", "prefix", F.lit(True).alias("in_whole"))
    days = open_.where("not whole").select("g", "p", "component", "prefix", F.lit(True).alias("in_part"))
    if goal <= broadcast_rows:
        live = keyed.join(F.broadcast(ends), ["g", "component", "prefix"], "left").join(F.broadcast(days), ["g", "p", "component", "prefix"], "left").where("in_whole or in_part")
        live = live.groupBy("g", "p", "component", "key", "in_whole", "in_part").count()
    else:
        # Equal values are one row before they meet the intervals, and the lattice cells with many values are spread over tasks.
        named = lambda *c: F.concat_ws("|", *(F.coalesce(F.col(x).cast("string"), F.lit("null")) for x in c))
        live = keyed.groupBy("g", "p", "component", "prefix", "key").count()
        total = parts.agg(F.sum("n")).first()[0] or 0
        for side, flag, by in ((ends, "in_whole", ("g", "component", "prefix")), (days, "in_part", ("g", "p", "component", "prefix"))):
            held = parts.withColumnRenamed("cell", "prefix").groupBy(named(*by).alias("at")).agg(F.sum("n").alias("n"))
            live = salted_join(live.withColumn("at", named(*by)), side.select(named(*by).alias("at"), flag), "at", heavy_keys(held, "at", "n", total), "left").drop("at")
        live = live.where("in_whole or in_part")
    live = scratch.save(live.select("component", "key", F.col("count").alias("n"), "g", "p", "in_whole", "in_part"), "live")
    each = live.where("in_part").select("g", "p", F.lit(False).alias("whole"), "component", "key", "n")
    all_ = live.where("in_whole").groupBy("g", "component", "key").agg(F.sum("n").alias("n"))
    live = each.unionByName(all_.select("g", F.lit(None).cast(df.schema[part].dataType).alias("p"), F.lit(True).alias("whole"), "component", "key", "n"))
    turn, keys = 0, ["g", "p", "whole", "component"]
    while shift > 0:
        wide = min(STEP, shift)
        now = live.select(*keys, F.shiftright("key", shift).alias("prefix"), F.shiftright("key", shift - wide).alias("cell"), "n", "key")
        cells = now.groupBy(*keys, "prefix", "cell").agg(F.sum("n").alias("n"), F.min("key").alias("least"), F.max("key").alias("most"))
        order = Window.partitionBy(*keys, "prefix").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).withColumnRenamed("n", "held")
        state = state.drop("least", "most")
        same = [state[k].eqNullSafe(cells[k]) for k in keys] + [state["prefix"] == cells["prefix"]]
        match = same[0] & same[1] & same[2] & same[3] & same[4] & (F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("held"))
        state = state.join(cells, match).select(*(state[k] for k in keys), "total", "fraction", (F.col("rank") - F.col("before")).alias("rank"), F.col("cell").alias("prefix"), "least", "most")
        shift -= wide
        turn += 1
        state = scratch.save(state, f"state{turn}")
        if state.where("least < most").isEmpty():
            break
    named = F.element_at(F.lit(values), F.col("component") + 1)
    columns = [F.max(F.when(F.col("fraction") == q, F.col("value"))).alias(f"p{round(q * 100):02d}") for q in FRACTIONS]
    out = state.withColumn("value", _value(F.col("least"))).groupBy("g", "p", "whole", "component").agg(F.max("total").alias("n"), *columns)
    return out.select(F.col("g").alias(group), F.col("p").alias(part), named.alias("component"), "n", *(f"p{round(q * 100):02d}" for q in FRACTIONS))
