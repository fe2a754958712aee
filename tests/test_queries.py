"""Every registered query of the matching library against its SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

from pairwright.plans.queries import ORACLE_SQL, QUERIES  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in ("customer", "supplier", "part", "orders"):
        con.sql(f"create view {name} as select * from read_parquet('{DATA}/{name}.parquet')")
    return con


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    return None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, str(DATA))
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(x) for x in r) for r in got.select(*columns).collect()), key=str)
    want = con.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({ORACLE_SQL[name]})")
    assert rows == sorted((tuple(plain(x) for x in r) for r in want.fetchall()), key=str)
