"""Every query over the standard tables against its SQL at the smallest scale."""

import os

import duckdb
import pytest

from curalith.plans import registry

SF = "/root/testdata/sf0.001"


def value(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    return round(float(x), 6) if type(x).__name__ == "Decimal" else x


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{t}')")
    got = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a = sorted((tuple(map(value, r)) for r in got.select(*cols).collect()), key=repr)
    b = sorted((tuple(map(value, r)) for r in con.sql(f"SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({registry.oracle_sql()[name]})").fetchall()), key=repr)
    assert a == b
