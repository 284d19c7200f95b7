"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest
from conftest import SF

from lidarloom.plans import catalogue

SQL = catalogue.oracle_sql()


def rows(df):
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return "None"
        return repr(float(v)) if isinstance(v, int | float) or "int" in type(v).__name__ or "float" in type(v).__name__ else str(v)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got)
        return
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    assert rows(got) == rows(con.execute(SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(catalogue.queries()) <= set(e.queries())
