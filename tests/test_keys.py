import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellframe.functions.keys import splitmix64, uniform_key, uniform_key_int
from cellframe.operators.skew import heavy_keys, salted_join


def test_fixed_values(spark):
    want = [0.34329192209867343, 0.9504380907279257, 0.4465878737451613, 0.9777767857540063, 0.28488162716264287]
    assert [uniform_key_int(i, 42) for i in range(5)] == want
    assert [r[0] for r in spark.range(5).select(uniform_key(F.col("id"), 42)).collect()] == want


def test_column_equals_integers(spark):
    ids = [0, 1, -1, 2**63 - 1, -(2**63), 4611686018435330048, 123456789012345]
    df = spark.createDataFrame([(i,) for i in [*ids, None]], "id long")
    for seed in (0, 7, 2**40):
        assert [r[0] for r in df.select(uniform_key(F.col("id"), seed)).collect()] == [uniform_key_int(i, seed) for i in ids] + [None]


@given(st.integers(0, 2**64 - 1))
def test_splitmix_is_64_bit(x):
    assert 0 <= splitmix64(x) < 2**64


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join(spark, how):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 5).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("x")).unionByName(spark.createDataFrame([(None, -1)], "k long, x long"))
    lookup = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("y"))
    counts = rows.groupBy("k").count()
    heavy = heavy_keys(counts, "k", "count", 3001)
    assert [r.k for r in heavy.collect()] == [5]
    assert sorted(map(str, salted_join(rows, lookup, "k", heavy, how).select("k", "x", "y").collect())) == sorted(map(str, rows.join(lookup, "k", how).select("k", "x", "y").collect()))
