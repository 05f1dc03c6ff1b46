"""Every query of the engine against its SQL, on the smallest tables of the driver."""

import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

from denialkit import device_queries as engine

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> Counter:
    def text(v):
        if not isinstance(v, (list, tuple)) and pd.isna(v):
            return "null"
        return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return Counter(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_query_equals_its_sql(spark, sql, name):
    got, want = engine.queries()[name](spark, FOLDER).toPandas(), sql.execute(engine.oracle_sql()[name]).df()
    spark.catalog.clearCache()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_without_sql_is_known():
    assert set(engine.queries()) - set(engine.oracle_sql()) == set()
