"""Every query against its SQL, on the smallest tables; queries of removable parts are not needed."""

import math
from pathlib import Path

import duckdb
import pytest

from corpusframe.plans.catalogue import ORACLE, QUERIES


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return float(f"{float(x):.9g}") if type(x).__name__ == "Decimal" else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    data = [tuple(r) for r in got.collect()]
    assert data and len(set(got.columns)) == len(got.columns)
    if name in ORACLE:
        cur = duck.execute(ORACLE[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(got.columns)
        assert rows(got.columns, data) == rows(names, cur.fetchall())


def test_entry_works_without_the_removable_part(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).count() > 0
