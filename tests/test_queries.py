"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from filinglens.plans import records_queries, scoring_queries, tier_queries

SF = "/root/testdata/sf0.001"
TABLES = "nation region customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {**records_queries.QUERIES, **scoring_queries.QUERIES, **tier_queries.QUERIES}
SQL = {**records_queries.SQL, **scoring_queries.SQL, **tier_queries.SQL}
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are missing")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    if name not in SQL:
        assert got
        return
    rel = duck.execute(SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert got == canonical(rel.fetchall(), names)
