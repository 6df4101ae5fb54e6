"""Every registered query against its SQL oracle, on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from factloom import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return c


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NaT:
        return None
    if isinstance(v, (float, np.floating)):
        return round(float(v), 6)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return float(v)
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(name, spark, sf_dir, con):
    got, want = catalog.QUERIES[name](spark, sf_dir).toPandas(), con.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_without_oracle(name, spark, sf_dir):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
