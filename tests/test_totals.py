import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.operators import dense_totals as dense_totals_module
from cellframe.operators.dense_totals import Axis, dense_totals

SCHEMA = "code long, k int, v double, block string"


def rows(n, seed=0):
    """A third of all rows has one key; nulls, NaN, infinite and huge values are strewn in."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        c = 3 if rng.random() < 0.35 else int(rng.integers(-1, 12))
        k = None if rng.random() < 0.05 else int(rng.choice([7, 9, 2_000_000_000, -5]))
        v = [None, float("nan"), float("inf"), 1.7e308, -1.25, rng.normal(0, 1e5), 0.1][int(rng.integers(7))]
        out.append((c, k, None if v is None else float(v), "x"))
    return out


def plain(data, size=10):
    want = {}
    for c, k, v, _ in data:
        key = (c, k) if 0 <= c < size and k is not None else (None, None)
        n, m, s = want.get(key, (0, 0, 0))
        if v is not None and abs(v) <= 1e12:
            m, s = m + 1, s + int(np.floor(v * 1e6 + 0.5))
        want[key] = (n + 1, m, s)
    return want


@pytest.mark.parametrize("limit", [65_536, 1])
@pytest.mark.parametrize("parts", [1, 5])
def test_against_plain_sums(spark, parts, limit):
    data = rows(3000)
    df = spark.createDataFrame(data, SCHEMA).repartition(parts)
    got = dense_totals(df, [Axis("c", F.col("code"), 10), Axis("k", F.col("k"))], {"v": F.col("v")}, fan_in=2, dictionary_limit=limit).collect()
    want = plain(data)
    assert {(r.c, r.k): (r.n, r.n_v, r.sum_v) for r in got} == {k: (n, m, s / 1e6) for k, (n, m, s) in want.items()}


def test_one_schema_on_both_ways(spark):
    df = spark.createDataFrame(rows(500), SCHEMA).withColumn("far", F.col("k").cast("long"))
    axes = [Axis("c", F.col("code"), 10), Axis("k", F.col("k")), Axis("far", F.col("far"))]
    a, b = (dense_totals(df, axes, {"v": F.col("v")}, dictionary_limit=n) for n in (65_536, 1))
    assert a.dtypes == b.dtypes and dict(a.dtypes)["far"] == "bigint" and dict(a.dtypes)["k"] == "int"
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_more_blocks_than_are_held(spark, monkeypatch):
    """A grid of 1000 x 1000 x 1000 cells by types: memory doesn't follow the number of keys."""
    monkeypatch.setattr(dense_totals_module, "HELD_BYTES", 1 << 20)
    axes = [Axis(n, F.col(n), 1000) for n in ("i", "j", "k")] + [Axis("t", F.col("t"))]
    mix = lambda m: F.pmod(F.xxhash64("id", F.lit(m)), F.lit(1000))
    df = spark.range(0, 30_000, 1, 3).select(*(F.when(F.col("id") % 3 == 0, 7).otherwise(mix(m)).alias(n) for m, n in enumerate(("i", "j", "k"))), (F.col("id") % 48).cast("int").alias("t"), (F.col("id") * 0.5).alias("v"))
    got = {(r.i, r.j, r.k, r.t): (r.n, r.sum_v) for r in dense_totals(df, axes, {"v": F.col("v")}).collect()}
    want = {(r.i, r.j, r.k, r.t): (r.n, r.v) for r in df.groupBy("i", "j", "k", "t").agg(F.count("*").alias("n"), F.sum("v").alias("v")).collect()}
    assert got == want


def test_same_bits_for_any_layout(spark):
    df = spark.createDataFrame(rows(2000, 1), SCHEMA)
    run = lambda d: sorted(map(tuple, dense_totals(d, [Axis("c", F.col("code"), 10)], {"v": F.col("v")}).collect()), key=str)
    assert run(df.repartition(1)) == run(df.repartition(13, F.rand(3)))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert dense_totals(df, [Axis("c", F.col("code"), 10), Axis("k", F.col("k"))], {"v": F.col("v")}).count() == 0
