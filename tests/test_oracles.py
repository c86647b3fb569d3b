"""Every registered query of the reference's operators against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from foliograph.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v) if v is not None and not isinstance(v, (int, bool)) else v


def rows(columns, data):
    return sorted((tuple(plain(r[c]) for c in columns) for r in data), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name not in registry.ORACLES:
        assert got
        return
    want = duck.sql(registry.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    assert rows(columns, got) == rows(columns, [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()])
