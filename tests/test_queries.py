"""Every registered query against its SQL, over the smallest whole tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from terrane.plans import registry

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def oracle():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}/*.parquet')" if p.is_dir() else f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(frame: pd.DataFrame) -> list[tuple]:
    value = lambda v: "null" if pd.isna(v) else repr(float(v)) if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(tuple(value(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, oracle, name):
    got = registry.queries()[name](spark, str(SF))
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got.count() > 0
        return
    want = oracle.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.toPandas()) == plain(want)
