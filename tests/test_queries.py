"""Every query with SQL gives the SQL's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from pitchflow.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("PITCHFLOW_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value if value is None or isinstance(value, (int, str, bool)) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    found = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    want = sorted((tuple(map(plain, r)) for r in found), key=repr)
    assert [[float(x) if isinstance(x, (int, float)) else x for x in r] for r in got] == [[float(x) if isinstance(x, (int, float)) else x for x in r] for r in want]
