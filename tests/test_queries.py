"""Every core query with SQL agrees with it on the smallest tables; the others run."""

import os

import pytest

import __spark_entry__ as entry_module
from tests.oracle import same, tables

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables here")

CORE = [m for m in entry_module._modules() if ".llm" not in m.__name__]
QUERIES = {n: q for m in CORE for n, q in m.QUERIES.items()}
SQL = {n: s for m in CORE for n, s in m.SQL.items()}


@pytest.fixture(scope="module")
def con():
    return tables(ROOT)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, ROOT)
    if name in SQL:
        same(df, con, SQL[name])
    else:
        assert df.columns
        df.write.format("noop").mode("overwrite").save()


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
