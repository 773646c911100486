"""Every query with an oracle gives the oracle's rows."""

import duckdb
import pytest
from tidemark.plans import entity_queries, loop_queries, more_queries, state_queries  # noqa: F401
from tidemark.plans.queries import SQL, Q

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "orders", "lineitem", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(v[i] for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    df = Q[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    r = db.execute(SQL[name])
    want = rows([c[0] for c in r.description], r.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]) > 0
    assert got[1] == want[1]
