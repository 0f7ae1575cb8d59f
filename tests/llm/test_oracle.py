"""Queries with an oracle against DuckDB, and pages against their article element."""

import html as htmllib
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tessera.llm import html, queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, str(DATA))
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(want.fetchall())


def test_pages_against_their_article_element():
    rows = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    for (page,) in rows:
        inner = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", page, re.S)[1]
        inner = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))
        assert html.main_text(page) == re.sub(r"\s+", " ", htmllib.unescape(inner)).strip()
