"""Every registered query of the library against its SQL in DuckDB."""

import math

import duckdb
import pandas as pd
import pytest

from chronotext.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if value is None or (not hasattr(value, "__len__") and pd.isna(value)):
        return ""
    if isinstance(value, str | bool):
        return str(value)
    try:
        x = float(value)
    except (TypeError, ValueError):
        return str(value)
    return "" if math.isnan(x) else repr(round(x, 6))


def rows(df):
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    mine = registry.queries()[name](spark, SF).toPandas()
    other = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert rows(mine) == rows(other)


def test_frame_times_of_large_keys(spark, tmp_path):
    keys = [0, 1, 5, 99_995, 99_996, 100_000, 100_005, 123_455, 1_000_001, 39_999_996, 40_000_001, 40_000_006, 40_000_002, 40_000_003, 40_000_004, 3_600_000_000, 3_600_000_011]
    pd.DataFrame({"o_orderkey": keys}).to_parquet(tmp_path / "orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet')")
    assert rows(registry.queries()["frame_times"](spark, str(tmp_path)).toPandas()) == rows(con.execute(registry.oracle_sql()["frame_times"]).df())
