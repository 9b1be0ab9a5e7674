"""Every registered query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import pytest

from oracle_compare import compare

import __spark_entry__ as E
from wardlake.plans import catalog


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "age" in df.columns


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, name):
    res = compare(spark, "/root/testdata/sf0.001", [name], verbose=False)[name]
    if res.get("oracle") is None and "oracle_rows" not in res:
        pytest.skip("no SQL form")
    assert res["cols_ok"], res
    assert res["rows"] == res["oracle_rows"], res
    assert res["values_ok"], res
