"""Plans: what is read, and joins that must not be there."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cellframe.domain import Domain
from cellframe.operators.neighbors import neighbors
from cellframe.operators.regions import Regions
from cellframe.runtime import Scratch, clear_scratch, fresh

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_boxes_reach_the_scan(spark):
    g = spark.read.parquet(f"{SF}/grid_fields.parquet")
    box = Regions().declare("BOX", bounds=((60.0, 450.0, 600.0), (240.0, 780.0, 960.0)), id_range=(1, 500))
    text = plan(g.where(box.predicate("BOX", tuple(F.col(f"r{a}") for a in "xyz"), F.col("id"))).select("id", "vx"))
    pushed = text.split("PushedFilters: ")[1].split("]")[0]
    assert "GreaterThanOrEqual(rx,60.0)" in pushed and "LessThan(id,500)" in pushed
    assert "proc_id" not in text.split("ReadSchema: ")[1]


def test_neighbour_join_is_an_equi_join(spark):
    g = spark.read.parquet(f"{SF}/grid_fields.parquet").select("id", "rx", "ry", "rz")
    text = plan(neighbors(g, Domain.cube(1950.0, 13, (True, True, False)), 5.0))
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "Join" in text


@pytest.mark.parametrize("name", ["p1_totals", "p2_inside", "region_stats", "grid_particle_histogram", "particle_cell_projection", "average_neighbors_scalar", "grid_particle_slicing"])
def test_no_cross_joins(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_scratch(spark):
    s = Scratch(spark, "test")
    df = s.save(spark.range(5), "t")
    assert df.count() == 5
    clear_scratch()
    with pytest.raises(Exception, match="(?i)not.*exist|not_exist"):
        spark.read.parquet(f"{s.root}/t").count()


def test_fresh_names(spark):
    assert fresh(spark.range(1).withColumn("__A", F.lit(1)), "a", "a") == ["__a_", "__a__"]
