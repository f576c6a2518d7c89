import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda x: f"{x:.9g}" if isinstance(x, float) and not math.isnan(x) else repr(x)
    return sorted(columns), sorted(tuple(shown(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = entry_module.queries()[name](spark, SF)
    result = duck.execute(entry_module.oracle_sql()[name])
    want = rows([d[0] for d in result.description], result.fetchall())
    assert rows(got.columns, got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(entry_module.queries()) - set(entry_module.oracle_sql())))
def test_runs(spark, name):
    assert entry_module.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
