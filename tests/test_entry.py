from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from spanfusion import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "events"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    result = db.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert mine == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())


def test_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
