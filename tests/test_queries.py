"""Each query with SQL, held against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from weftspark import queries

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return [plain(x) for x in v] if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(DATA):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


#: Queries whose rows have an order.
ORDERED = {"activity_feed", "activity_toasts", "package_list", "package_view", "selection_in_order", "texture_sets_sorted"}
ORDERED |= {f"package_sort_{how}" for how in ("name_asc", "name_desc", "size_desc", "date_desc")}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    mine = queries.queries()[name](spark, DATA)
    theirs = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(columns) == sorted(mine.columns)
    key = lambda r: str(r)
    rows, expected = [[plain(x) for x in r] for r in mine.select(*columns).collect()], [[plain(x) for x in r] for r in theirs.fetchall()]
    if name not in ORDERED:
        rows, expected = sorted(rows, key=key), sorted(expected, key=key)
    assert rows == expected
