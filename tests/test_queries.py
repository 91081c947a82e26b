"""Every query with SQL gives the same rows as DuckDB, and rows at all."""

import duckdb
import pytest

from sievelight.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    own = [tuple(r) for r in df.select(*columns).collect()]
    if name not in catalog.ORACLES:
        assert own
        return
    r = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == columns
    want = [tuple(x[names.index(c)] for c in columns) for x in r.fetchall()]
    assert sorted(map(repr, own)) == sorted(map(repr, want))
