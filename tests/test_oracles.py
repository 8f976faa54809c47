"""Every query against its DuckDB SQL on the small tables: rows, types and values."""

import glob
import math
import os

import duckdb
import pytest

from tallyframe import plans

TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


@pytest.fixture(scope="session")
def duck(small):
    connection = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def ordered(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted([tuple(plain(r[i]) for i in at) for r in rows], key=lambda r: [(x is None, x or "") for x in r])


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, small, duck, name):
    found = plans.QUERIES[name](spark, small)
    rows = found.collect()
    assert rows and len(set(found.columns)) == len(found.columns)
    if name in plans.ORACLES:
        want = duck.sql(plans.ORACLES[name])
        assert sorted(want.columns) == sorted(found.columns)
        assert {c: TYPES.get(str(t)) for c, t in zip(want.columns, want.types, strict=True)} == dict(found.dtypes)
        assert ordered(rows, found.columns) == ordered(want.fetchall(), want.columns)


def test_only_folds_lack_sql():
    assert set(plans.QUERIES) - set(plans.ORACLES) == {"table_items", "extract_items_js", "extract_items_py", "anchored_fields"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
