"""Percentiles, stable sample and groups against plain versions."""

import datetime
import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellframe.functions.keys import uniform_key_int
from cellframe.llm.groups import group_ids
from cellframe.llm.percentiles import FRACTIONS, digest, digest_percentiles, from_key, merge, percentiles, to_key
from cellframe.llm.sample import NumberStore, stable_sample

DAY = datetime.date(2031, 3, 1)
ROWS = "type int, day date, v double, cell string, g int"


def values(n, seed=0):
    """A third of all rows in one type, many of one value; dirt in every field."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        t = 1 if rng.random() < 0.4 else [2, 3, None][int(rng.integers(3))]
        d = None if rng.random() < 0.05 else DAY + datetime.timedelta(int(rng.integers(3)))
        v = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 1.5, 1.5, 1e9, -1e-300, float(rng.normal()), float(rng.lognormal(0, 5)), float(rng.normal())][int(rng.integers(13))]
        out.append((t, d, v, "x", 5))
    return out


def exact(vs):
    s = sorted(vs)
    return [s[max(1, math.ceil(q * len(s))) - 1] for q in FRACTIONS]


@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=2, max_size=50))
def test_keys_keep_the_order(vs):
    a = np.array(vs)
    k = to_key(a)
    k_sorted = k[np.argsort(a, kind="stable")]
    assert (k_sorted[1:] >= k_sorted[:-1]).all()
    assert (from_key(to_key(a)) == a).all()


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_percentiles_are_exact(spark, broadcast_rows):
    rows = values(4000)
    got = {(r.type, r.day, r.component): (r.n, [r[f"p{round(q * 100):02d}"] for q in FRACTIONS]) for r in percentiles(spark.createDataFrame(rows, ROWS), "type", "day", ["v"], broadcast_rows).collect()}
    want = {}
    for t, d, v, *_ in rows:
        if t is not None and v is not None and math.isfinite(v):
            for key in {(t, None, "v"), (t, d, "v")}:
                want.setdefault(key, []).append(v)
    assert got == {k: (len(vs), exact(vs)) for k, vs in want.items()}


def test_one_value_and_empty(spark):
    same = spark.createDataFrame([(1, DAY, 2.5, "x", 0)] * 50, ROWS)
    assert {tuple(r)[4:] for r in percentiles(same, "type", "day", ["v"]).collect()} == {(2.5,) * 7}
    assert percentiles(spark.createDataFrame([], ROWS), "type", "day", ["v"]).count() == 0
    assert percentiles(spark.createDataFrame([(1, DAY, math.nan, "x", 0)], ROWS), "type", "day", ["v"]).count() == 0


def test_digests_join_and_bound(spark):
    rows = values(3000, 4)
    df = spark.createDataFrame(rows, ROWS).where("type is not null")
    parts = [digest(df.where(F.col("day") == d), ["type", "day"], ["v"]) for d in sorted({r[1] for r in rows if r[1]})]
    joined = parts[0]
    for p in parts[1:]:
        joined = joined.unionByName(p)
    got = {(r.type, r.fraction): (r.lo, r.hi) for r in digest_percentiles(merge(joined, ["type"]), ["type"]).collect()}
    for t in (1, 2, 3):
        e = exact([r[2] for r in rows if r[0] == t and r[1] and r[2] is not None and math.isfinite(r[2])])
        for q, v in zip(FRACTIONS, e):
            lo, hi = got[t, q]
            assert lo <= v <= hi and hi - lo <= 2.0**-8 * max(abs(lo), abs(hi)) + 2.0**-1022


def records(ids):
    return [(i, 3, float(k)) for k, i in enumerate(ids)]


def test_sample_is_stable(spark):
    ids = [int(x) for x in np.random.default_rng(1).integers(0, 2**62, 800)] + [7] * 1200 + [-5, None, None]
    df = spark.createDataFrame(records(ids), "id long, u int, at double")
    got = stable_sample(df, 0.3, seed=5).collect()
    chosen = {r.id for r in got}
    assert Counter(r.id for r in got) == Counter(i for i in ids if i in chosen) and None not in chosen
    again = stable_sample(df.repartition(9, F.rand(2)), 0.3, [F.col("at") < 900, F.col("at") >= 900], seed=5)
    assert Counter(r.id for r in again.collect()) == Counter(r.id for r in got)
    assert 0.2 < len(chosen) / len(set(ids)) < 0.4
    assert stable_sample(df, 0.0).count() == 0 and stable_sample(df, 1.0).count() == len(ids) - 2
    assert stable_sample(df.limit(0), 0.5).count() == 0


def test_store_keeps_numbers_and_threshold(spark, tmp_path):
    store = NumberStore(spark, f"{tmp_path}/s", seed=1)
    store.insert(spark.range(100))
    first = {r.id: r.u for r in store.read().collect()}
    before = {r.id for r in store.chosen(0.2).collect()}
    store.insert(spark.range(50, 300))
    store.insert(spark.range(50, 300), batch=1)  # the same batch again
    later = NumberStore(spark, f"{tmp_path}/s", seed=1)
    now = {r.id: r.u for r in later.read().collect()}
    assert len(now) == 300 == later.read().count() and all(now[i] == u for i, u in first.items())
    assert before <= {r.id for r in later.chosen(0.1).collect()}  # the threshold doesn't fall
    with pytest.raises(ValueError):
        later.threshold(1.5)


def test_batches_only_add(spark, tmp_path):
    store = NumberStore(spark, f"{tmp_path}/s")
    store.insert(spark.range(10), batch=0)
    held = {r.id: r.u for r in store.read().collect()}
    store.insert(spark.range(100, 105), batch=0)  # a number that is taken, with other ids
    assert store.read().count() == 15 and {r.id: r.u for r in store.read().where("id < 10").collect()} == held


def test_numbers_come_from_the_store(spark, tmp_path):
    """A second session with another seed: old ids keep their numbers, only new ones are drawn by its seed."""
    one = NumberStore(spark, f"{tmp_path}/s", seed=1)
    one.insert(spark.range(200))
    old = {r.id: r.u for r in one.read().collect()}
    other = spark.newSession()
    two = NumberStore(other, f"{tmp_path}/s", seed=99)
    rows = other.createDataFrame([(i, 0) for i in range(300)], "id long, x int")
    got = {r.id: r.u for r in stable_sample(rows, 1.0, store=two).collect()}
    assert len(got) == 300 and all(got[i] == u for i, u in old.items())
    assert all(got[i] == uniform_key_int(i, 99) != uniform_key_int(i, 1) for i in range(200, 300))


def test_two_writers_and_a_lost_one(spark, tmp_path):
    a, b = NumberStore(spark, f"{tmp_path}/s", seed=1), NumberStore(spark, f"{tmp_path}/s", seed=2)
    a.insert(spark.range(5))
    seen = []
    real = b.read
    b.read = lambda: seen.append(a.insert(spark.range(5, 30))) or real() if not seen else real()  # a writes while b does
    b.insert(spark.range(20, 40), batch=1)
    b.read = real
    spark.range(1000, 1010).selectExpr("id", "0.0 as u", "7L as batch").write.parquet(f"{tmp_path}/s/numbers-dead")  # a writer that was lost
    now = {r.id: r.u for r in a.read().collect()}
    assert set(now) == set(range(40)) and all(now[i] == uniform_key_int(i, 1) for i in range(30)) and now == {r.id: r.u for r in b.read().collect()}
    a.insert(spark.range(40, 50))
    assert {r.id: r.u for r in a.read().where("id < 40").collect()} == now


def union_find(pairs):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {x: top(x) for x in up}


@pytest.mark.parametrize("seed", range(3))
def test_groups_against_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    ids = [int(x) for x in rng.permutation(10**6)[:400]]
    pairs = [(ids[i], ids[i + 1]) for i in range(120)]  # a long chain
    pairs += [(ids[200], ids[j]) for j in range(201, 300)] * 2  # a hub, repeated
    pairs += [(ids[int(a)], ids[int(b)]) for a, b in rng.integers(300, 400, (60, 2))]
    pairs += [(None, 1), (2, None), (ids[0], ids[0]), (999_999_999, 999_999_999)] + [(b, a) for a, b in pairs[:30]]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a long, b long, group_id double")
    got = group_ids(df).collect()
    assert {r.id: r.group_id for r in got} == union_find(pairs) and len(got) == len(union_find(pairs))


def test_groups_of_nothing(spark):
    assert group_ids(spark.createDataFrame([], "a long, b long")).count() == 0
