"""Every query of the catalog against its SQL, at the smallest size."""

import math

import duckdb
import pytest

from corpusloom.plans import catalog
from corpusloom.plans.registry import TABLES


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, db, name):
    df = catalog.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in catalog.ORACLES:
        found = db.sql(catalog.ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert rows == sorted(tuple(plain(r[k]) for k in at) for r in found.fetchall())


def test_entry_imports():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
