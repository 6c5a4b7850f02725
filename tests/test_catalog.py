"""Each registered query against its SQL twin in DuckDB."""

import glob
import os

import numpy as np
import pandas as pd
import pytest

from ridgeline.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        files = glob.glob(f"{path}/*") if os.path.isdir(path) else [path]
        if files:
            con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet({files})")
    return con


def rows(frame):
    def cell(v):
        if pd.isna(v):
            return "null"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, float) or hasattr(v, "dtype") or type(v).__name__ == "int":
            return f"{float(v):.9g}" if not hasattr(v, "isoformat") else v.isoformat()
        return str(v)[:19].removesuffix(" 00:00:00")

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, r)) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_matches_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
