"""Every query over the reference operators against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from cairn.plans import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_gives_the_rows_of_its_sql(spark, name):
    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = registry.queries()[name](spark, SF)
    want = db.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=key)
    at = [want.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)
    assert mine == theirs
