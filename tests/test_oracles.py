"""Every query with SQL gives DuckDB's rows, every other one runs, at the smallest scale."""

import duckdb
import pytest

from orpheon.plans.catalog import CATALOG

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def shown(rows):
    return sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(CATALOG.builders))
def test_query(spark, duck, name):
    rows = CATALOG.builders[name](spark, SF)
    columns = sorted(rows.columns)
    got = rows.select(*columns).collect()
    if name not in CATALOG.oracles:
        assert got
        return
    asked = duck.sql(CATALOG.oracles[name])
    assert sorted(asked.columns) == columns
    assert shown(got) == shown(asked.select(*(f'"{c}"' for c in columns)).fetchall())
