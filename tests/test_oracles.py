"""Every query that SQL can express gives DuckDB's rows, and more than one of them."""

from __future__ import annotations

import pytest

from curatorium.plans import catalog
from tests.compare import duck_rows, rows_of

#: Queries whose answer is one row by nature.
SINGLE = ()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, data, name):
    df = catalog.QUERIES[name](spark, data)
    columns, rows = duck_rows(data, catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(columns)
    mine, theirs = rows_of(df.columns, df.collect()), rows_of(columns, rows)
    assert mine == theirs, f"{list((mine - theirs).items())[:3]} {list((theirs - mine).items())[:3]}"
    assert len(mine) > 1 or name in SINGLE


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_has_rows(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 1
