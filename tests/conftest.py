from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quaestor.session import session

    shared = tmp_path_factory.mktemp("shared")
    warehouse = tmp_path_factory.mktemp("warehouse")
    s = session("local[4]", 4, spark__checkpoint__dir=f"file://{shared}", spark__sql__warehouse__dir=str(warehouse), spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.fixture
def same(spark, duck):
    """Asserts that a query's rows and its SQL's rows are the same, whatever their order."""

    def check(query, sql: str) -> int:
        df = query(spark, SMALL)
        columns = sorted(df.columns)
        mine = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
        cursor = duck.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        theirs = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in cursor.fetchall())
        assert mine == theirs
        return len(mine)

    return check
