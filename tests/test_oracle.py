"""Every query with an oracle against DuckDB on the smallest tables."""

import duckdb
import pytest

from millrace import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(rows):
    return sorted(tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = shown(df.select(*[f"`{c}`" for c in columns]).collect())
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    at = [x[0] for x in cursor.description]
    assert sorted(at) == columns
    assert got == shown([tuple(r[at.index(c)] for c in columns) for r in cursor.fetchall()])


def test_entry(spark):
    assert catalog.entry(spark).count() == 5
