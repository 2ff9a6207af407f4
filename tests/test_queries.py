"""Every query against its SQL on the smallest tables, as the driver does it."""

import math

import duckdb
import pytest

from palimpsest import catalog
from palimpsest.plans.text_queries import FIXED_QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted([*catalog.ORACLE_SQL, *FIXED_QUERIES]))
def test_equals_sql(spark, duck, name):
    run, oracle = FIXED_QUERIES[name] if name in FIXED_QUERIES else (catalog.QUERIES[name], catalog.ORACLE_SQL[name])
    got = run(spark, SF)
    cursor = duck.execute(oracle)
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    want = sorted(tuple(plain(row[names.index(c)]) for c in sorted(names)) for row in cursor.fetchall())
    assert sorted(tuple(plain(row[c]) for c in sorted(names)) for row in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
