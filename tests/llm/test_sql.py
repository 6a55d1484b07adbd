"""Every query of the subpackage with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from packetloom.llm import queries as q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def norm(v):
    return repr(round(v, 8) + 0.0) if isinstance(v, float) else repr(int(v)) if isinstance(v, bool) else repr(v)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query(spark, db, name):
    got = q.queries()[name](spark, DATA)
    want = db.execute(q.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(tuple(map(norm, r)) for r in got.select(*columns).collect()) == sorted(tuple(map(norm, r)) for r in want.fetchall())
