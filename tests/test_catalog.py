"""Every query against its SQL on the smallest tables, where those are there."""

import math
from decimal import Decimal
from pathlib import Path

import pytest

from winnow import catalog

FOLDER = Path("/root/testdata/sf0.001")
ORACLE = catalog.oracle_sql()


def _value(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def test_names_of_the_problems_are_free():
    assert [q for q in catalog.queries() if q[0] == "p" and q[1].isdigit()] == ["p5_found"]
    assert set(ORACLE) <= set(catalog.queries())


@pytest.mark.skipif(not FOLDER.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    got = sorted(tuple(_value(v) for v in r) for r in df.select(*columns).collect())
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(_value(r[i]) for i in at) for r in result.fetchall())
