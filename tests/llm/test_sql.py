"""Corpus queries against their DuckDB SQL."""

import pytest

from tallyframe.llm import queries
from tests.test_oracles import TYPES, duck, ordered  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, small, duck, name):  # noqa: F811
    found = queries.QUERIES[name](spark, small)
    want = duck.sql(queries.ORACLES[name])
    assert {c: TYPES[str(t)] for c, t in zip(want.columns, want.types, strict=True)} == dict(found.dtypes)
    assert ordered(found.collect(), found.columns) == ordered(want.fetchall(), want.columns)


def test_every_operator_is_there():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
