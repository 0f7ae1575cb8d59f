"""Every query with an oracle against DuckDB on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tessera.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
TABLES = [*catalogue.TABLES, "embeddings"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(v[i] for i in order) for v in values), sorted(columns)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, duck, name):
    got = catalogue.QUERIES[name](spark, str(DATA))
    want = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert rows(got.columns, map(tuple, got.collect())) == rows(columns, want.fetchall())


def test_every_query_has_an_oracle():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
