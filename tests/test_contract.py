"""Queries of the library against their SQL, over the driver's smallest tables."""

import math
import os

import pytest

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")

from gridsift.queries import ORACLE_SQL, QUERIES  # noqa: E402
from gridsift.queries.tables import NAMES  # noqa: E402

#: Found nothing by their nature: no such column.
EMPTY = {"search_missing_column"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    return str(value)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    assert bool(got) == (name not in EMPTY)
    if name in ORACLE_SQL:
        out = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in out.description]
        assert sorted(names) == columns
        assert got == sorted([plain(r[names.index(c)]) for c in columns] for r in out.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(ORACLE_SQL) <= set(QUERIES) <= set(e.queries())
