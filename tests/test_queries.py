"""Every ledger query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from tallyweave.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return str(bool(v))
    try:
        return repr(round(float(v), 6) + 0.0) if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def rows_of(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(map(_plain, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_its_sql(spark, duck, name):
    found = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert list(found.columns)
        return
    want = duck.sql(sql).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert rows_of(found) == rows_of(want)
