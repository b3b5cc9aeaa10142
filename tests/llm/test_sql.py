"""Queries with SQL give the rows that DuckDB gives."""

import os
from pathlib import Path

import duckdb
import pytest

from trustline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf_dir, name):
    duck = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    df = queries.QUERIES[name](spark, sf_dir)
    want = duck.execute(queries.ORACLES[name])
    order = sorted(df.columns)
    assert order == sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in order]
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=str)
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
