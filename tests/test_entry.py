"""The entry points, and each query of the core against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from driftloom.plans import engine, problems

FOLDER = Path("/root/testdata/sf0.001")
QUERIES, SQL = problems.QUERIES | engine.QUERIES, problems.SQL | engine.SQL

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="needs the generated tables")


def rows(frame: pd.DataFrame) -> list[str]:
    """The rows as sorted text, columns by name, numbers to six digits."""
    out = pd.DataFrame(index=frame.index)
    for c in sorted(frame.columns):
        v = frame[c]
        if v.dtype.kind in "iuf" or str(v.dtype).startswith(("Int", "Float")):
            v = v.astype("float64").round(6) + 0.0
        elif v.dtype.kind == "M":
            v = v.astype("datetime64[us]")
        out[c] = v.astype(object).where(v.notna(), None)
    return sorted(map(repr, out.itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in FOLDER.iterdir():
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    result = entry.entry(spark)
    assert result.count() > 0 and result.columns[:2] == ["series_id", "t"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, str(FOLDER)).toPandas()
    if name in SQL:
        want = tables.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got) and not np.array([c is None for c in got.columns]).any()
