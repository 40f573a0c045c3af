"""Every registered query against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from gridlark import catalog, catalog_sources  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 4) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


#: Bars or buckets are chosen by the number of distinct values, which differs in the smallest tables.
OTHER_PATH = {"chart_split_buckets", "chart_line_raw", "chart_grain_hour_bucketed", "chart_grain_minute_bucketed", "chart_grain_second_bucketed"}


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - OTHER_PATH))
def test_same_rows(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    rel = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(got.columns) == sorted(names)
    pick = sorted(names)
    ours = sorted(repr([plain(r[c]) for c in pick]) for r in got.collect())
    theirs = sorted(repr([plain(r[names.index(c)]) for c in pick]) for r in rel.fetchall())
    assert ours == theirs
