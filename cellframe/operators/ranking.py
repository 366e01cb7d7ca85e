"""Dense numbering of a whole relation without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.domain import Domain
from cellframe.functions.vec import matvec, vec
from cellframe.operators.regions import Region, Regions
from cellframe.runtime import Scratch, fresh

ROW_BITS = (1 << 33) - 1


def dense_number(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds 0..n-1 in the given order: range partitions are numbered apart and shifted by the sizes before them.

    The ordered table is written once, so that both passes see the same
    partitions. Rows that tie in the order get different numbers, in no set order.
    """
    part, at, before = fresh(df, "part", "at", "before")
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    mono = F.monotonically_increasing_id()
    placed = Scratch(df.sparkSession, "number").save(ranged.withColumns({part: F.shiftright(mono, 33), at: mono.bitwiseAND(F.lit(ROW_BITS))}), "ordered")
    total, offsets = 0, []
    for p, n in placed.groupBy(part).count().orderBy(part).collect():  # one row a partition
        offsets.append((p, total))
        total += n
    shifts = df.sparkSession.createDataFrame(offsets, f"{part} long, {before} long")
    return placed.join(F.broadcast(shifts), part).withColumn(name, F.col(at) + F.col(before)).drop(part, at, before)


def compact_ids(df: DataFrame, domain: Domain) -> DataFrame:
    """ids 0..n-1 by cell (z, y, x of the cell), then by old id."""
    cells = domain.with_cells(df, ("__ci", "__cj", "__ck"))
    out = dense_number(cells, ["__ck", "__cj", "__ci", "id"], "__new")
    return out.withColumn("id", F.col("__new")).select(*df.columns)


def track_regions(df: DataFrame, domain: Domain, regions: Regions, names: list[str], expressions: list[str] | None = None) -> tuple[DataFrame, Regions]:
    """New ids: the particles of each region are one block, in the order of the regions, the rest comes last.

    A particle belongs to the first region that holds it; inside a block the old
    ids give the order. The returned registry has each block's id range under its name.
    """
    r = matvec(domain.xform, vec("r"))
    index = F.lit(len(names))
    for i, e in reversed(list(enumerate(expressions or names))):
        index = F.when(regions.predicate(e, r, F.col("id")), F.lit(i)).otherwise(index)
    marked = df.withColumn("__block", index)
    sizes = dict(marked.groupBy("__block").count().collect())  # one row a region
    out = dense_number(marked, ["__block", "id"], "__new").withColumn("id", F.col("__new")).select(*df.columns)
    start, known = 0, dict(regions.known)
    for i, n in enumerate(names):
        size = sizes.get(i, 0)
        known[n] = Region(n, start, start + size)
        start += size
    return out, Regions(known)


def next_id(df: DataFrame) -> int:
    """One above the greatest id, 0 for an empty table."""
    greatest = df.agg(F.max("id")).first()[0]
    return 0 if greatest is None else greatest + 1
