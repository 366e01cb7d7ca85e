import duckdb
import pytest

import __spark_entry__ as entry
from cellframe.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings grid_fields neighbors particle_types regions sim_domain benchmark common_words".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if v is None or isinstance(v, (bool, int)):
        return v
    return float(v) if type(v).__name__ == "Decimal" else str(v)


CHECKED = sorted(catalogue.ORACLES)


def tables():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    c = tables()
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=str)
    rel = c.sql(entry.oracle_sql()[name])
    at = [rel.columns.index(n) for n in names]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60


def test_entry(spark):
    assert entry.entry(spark).count() == 1
