"""Every query against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from docloom import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the small tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool, int)):
        return v
    return "nan" if isinstance(v, float) and math.isnan(v) else float(v) + 0.0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    found = duck.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want


def test_flagship_has_rows(spark):
    assert registry.flagship(spark, SF).limit(1).count() == 1
