"""Every query of the catalogue against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from gridloom.plans import catalog, grids

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.QUERIES | grids.QUERIES, catalog.ORACLES | grids.ORACLES


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype.kind == "f":
            frame[c] = frame[c].round(5) + 0.0
    return sorted(map(tuple, frame.astype(str).replace({"nan": "-", "<NA>": "-", "None": "-", "NaT": "-"}).to_numpy().tolist()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_points_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
