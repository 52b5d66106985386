"""Queries against their SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from spanfusion.llm import queries
from spanfusion.llm.oracles import ORACLES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    got = queries.QUERIES[name](spark, FOLDER)
    with duckdb.connect() as db:
        for name_ in ("documents", "benchmark", "conversations"):
            db.execute(f"CREATE VIEW {name_} AS FROM '{FOLDER}/{name_}.parquet'")
        found = db.execute(ORACLES[name])
        names = [c[0] for c in found.description]
        wanted = found.fetchall()
    assert sorted(names) == sorted(got.columns)
    order = lambda row: tuple((v is None, v) for v in row)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=order) == sorted(wanted, key=order)
