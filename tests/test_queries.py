"""Every query with an oracle equals DuckDB on the smallest tables; the others run."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from fieldloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


#: Its rasters hold no pixel of the few parts of the smallest tables.
EMPTY = {"pixels_in_polygon"} if SF.endswith("sf0.001") else set()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, oracle, name):
    df = catalog.queries()[name](spark, SF)
    rows = df.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = oracle.execute(sql)
    names = [d[0] for d in found.description]
    want = found.fetchall()
    assert want or name in EMPTY, "an oracle without rows shows nothing"
    assert sorted(names) == sorted(df.columns)
    order = sorted(df.columns)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    got = sorted((tuple(cell(r[c]) for c in order) for r in rows), key=key)
    assert got == sorted((tuple(cell(r[names.index(c)]) for c in order) for r in want), key=key)
