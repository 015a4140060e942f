"""The subpackage's queries on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from driftloom.llm.queries import QUERIES, SQL

FOLDER = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="needs the generated tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, str(FOLDER))
    if name in SQL:
        con = duckdb.connect()
        for table in ("proximity", "documents", "pack_capacities", "source_targets"):
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
        want = con.sql(SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(tuple, got.select(*sorted(got.columns)).collect()), key=str) == sorted(want.select(*[f'"{c}"' for c in sorted(want.columns)]).fetchall(), key=str)
    else:
        assert got.count() > 0
