"""One group identifier for all records linked directly or over others, by seed-tree pruning.

In a round every vertex links itself and its neighbours to the smallest of them.
A vertex that nobody takes for a minimum drops out and hangs below its own
smallest candidate in the propagation forest; the others go on, joined to each
other through the candidates they share. When no edge is left the remaining
vertices are the seeds, each the smallest id of its group, and seed ids flow
down the forest, the last round's vertices first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.operators.skew import heavy_keys, salted_join
from cellframe.runtime import Scratch


def _both_ways(edges: DataFrame) -> DataFrame:
    """Distinct (u, v) in both directions from pairs (a, b) with a < b."""
    return edges.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))


def _ordered(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def group_ids(pairs: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, group_id): every id of a pair with the smallest id of its group.

    `pairs` has a and b. Pairs with a null end, and pairs of a record with
    itself, link nothing (such an id has a row only if another pair has it).
    Repeated pairs and both directions change nothing; further columns are not
    read; an empty table gives no rows. Joins treat hubs apart, so one id may
    stand in a third of all pairs.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark, "groups")
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    edges = scratch.save(pairs.where(a.isNotNull() & b.isNotNull() & (a != b)).select(*_ordered(a, b)).distinct(), "edges0")
    first, rounds, n = edges, [], edges.count()
    for turn in range(max_rounds):
        if not n:
            break
        directed = _both_ways(edges)
        least = scratch.save(directed.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("degree")), f"least{turn}")
        hubs = heavy_keys(least, "u", "degree", 2 * n)
        given = salted_join(directed, least.select("u", "m"), "u", hubs).select(F.col("v").alias("u"), "m")
        links = scratch.save(given.unionByName(least.select("u", "m")).distinct(), f"links{turn}")
        taken = scratch.save(links.groupBy("u").agg(F.min("m").alias("first"), F.max(F.col("m") == F.col("u")).alias("seed"), F.count("*").alias("degree")), f"taken{turn}")
        rounds.append(taken)
        joined = salted_join(links, taken.select("u", "first"), "u", heavy_keys(taken, "u", "degree", 3 * n))
        edges = scratch.save(joined.where(F.col("m") != F.col("first")).select(*_ordered(F.col("m"), F.col("first"))).distinct(), f"edges{turn + 1}")
        n = edges.count()
        scratch.drop(f"least{turn}")
        scratch.drop(f"links{turn}")
    else:
        if n:
            raise RuntimeError(f"edges are left after {max_rounds} rounds")
    # Seeds never fell; the others have the label of the vertex they hang below, which fell later or is a seed.
    ids = first.select(F.inline(F.array(F.struct(F.col("a").alias("id")), F.struct(F.col("b").alias("id"))))).distinct()
    fallen = [t.where("not seed").select(F.col("u").alias("id"), F.col("first").alias("parent")) for t in rounds]
    down_ids = [below.select("id") for below in fallen]
    seeds = ids.join(reduce(DataFrame.unionByName, down_ids), "id", "left_anti") if down_ids else ids
    labels = scratch.save(seeds.select("id", F.col("id").alias("group_id")), "seeds")
    for turn, below in reversed(list(enumerate(fallen))):
        counts = below.groupBy("parent").count()
        heavy = heavy_keys(counts, "parent", "count", below.count())
        down = salted_join(below, labels.withColumnRenamed("id", "parent"), "parent", heavy).select("id", "group_id")
        labels = scratch.save(labels.unionByName(down), f"labels{turn}")
        if turn + 2 <= len(fallen) - 1:
            scratch.drop(f"labels{turn + 2}")
    return labels
