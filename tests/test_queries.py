"""Every reporting query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__  # noqa: F401  registers the queries
from bourseline.plans import registry

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if v is None:
        return (0, "")
    if isinstance(v, str) or hasattr(v, "isoformat"):
        return (2, str(v))
    v = float(v)
    return (1, "nan" if math.isnan(v) else repr(v + 0.0))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    frame = registry.QUERIES[name](spark, str(DATA))
    columns = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    if name not in registry.ORACLE_SQL:
        assert got
        return
    result = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
