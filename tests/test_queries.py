"""Every query with SQL, against DuckDB on the smallest tables; every other query runs."""

import math
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry_module  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float) and not math.isnan(x):
        return round(x, 6)
    if x is None or x is pd.NaT or isinstance(x, float):
        return None
    return str(pd.Timestamp(x)) if hasattr(x, "isoformat") else x.item() if hasattr(x, "item") else x


def rows(df):
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = entry_module.queries()[name](spark, sf_dir).toPandas(), con.sql(entry_module.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry_module.entry(spark).count() == 10


def test_sql_has_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
